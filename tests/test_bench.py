"""The bench runs to its end on the smallest tables."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line():
    env = os.environ | {
        "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4", "BENCH_COPIES": "2",
        "BENCH_EPOCHS": "1", "PYTHONDONTWRITEBYTECODE": "1",
    }
    done = subprocess.run([sys.executable, f"{ROOT}/bench.py"], env=env, capture_output=True,
                          text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    result = json.loads(done.stdout.strip().splitlines()[-1])
    assert result["value"] > 0 and result["scale"]["n_objects"] == 1000
