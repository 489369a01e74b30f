"""bench.py prints one JSON line with the agreed keys (tiny settings)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_smoke():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_WARMUPS="0",
               BENCH_RUNS="1", BENCH_GEN_SIZES="1300", RULEFRAME_DRIVER_MEMORY="2g")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True,
                         text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1
    res = json.loads(lines[0])
    for k in ("metric", "value", "unit", "queries", "sf"):
        assert k in res
    assert res["unit"] == "sec" and res["value"] > 0
    assert "rule_runner" in res["queries"] and "rule_runner@1k" in res["queries"]
