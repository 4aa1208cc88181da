"""Summarise a Spark event log (as written by `BENCH_EVENTLOG=<dir> python bench.py`):
jobs with their wall time and the slowest stages.

usage: python tools/eventlog.py <eventlog folder or file> [top_n]
"""

from __future__ import annotations

import io
import json
import os
import sys


def _lines(path: str):
    files = [path] if os.path.isfile(path) else sorted(
        os.path.join(path, f) for f in os.listdir(path) if f.startswith("events") or f.startswith("app"))
    for fp in files:
        raw = open(fp, "rb")
        if fp.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            if line.strip():
                yield json.loads(line)


def main() -> None:
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages, jobs = {}, {}
    for e in _lines(path):
        ev = e.get("Event")
        if ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"][:60], si["Number of Tasks"],
                                      si.get("Completion Time", 0) - si.get("Submission Time", 0))
        elif ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, len(e.get("Stage IDs", []))]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][1] = e["Completion Time"]
    if not jobs:
        print("no jobs found")
        return
    t0 = min(v[0] for v in jobs.values())
    print(f"{len(jobs)} jobs, {len(stages)} stages, stage time {sum(s[2] for s in stages.values()) / 1000:.1f}s")
    for j, (s, c, n) in sorted(jobs.items(), key=lambda kv: -((kv[1][1] or kv[1][0]) - kv[1][0]))[:top]:
        print(f"  job {j}: +{(s - t0) / 1000:.2f}s  {((c or s) - s) / 1000:.2f}s  {n} stages")
    for k, (name, tasks, ms) in sorted(stages.items(), key=lambda kv: -kv[1][2])[:top]:
        print(f"  stage {k}: {ms / 1000:.2f}s  {tasks} tasks  {name}")


if __name__ == "__main__":
    main()
