"""A model of more files than a process may have open."""

import resource
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import resource, sys, types
import numpy as np
resource.setrlimit(resource.RLIMIT_NOFILE, (256, resource.getrlimit(resource.RLIMIT_NOFILE)[1]))
from tidewatch.llm import kneser_ney
mapped = kneser_ney.Mapped(types.SimpleNamespace(root=sys.argv[1], offsets=[0], bits=0, bounds=[]))
for again in range(2):
    for i in range(1200):
        assert mapped.array(f"range-{i}").tolist() == [i, again * 0 + 7]
held = mapped.array("range-0")
assert len(mapped.files) <= kneser_ney.OPEN and held.tolist() == [0, 7]
lines = sum(sys.argv[1] in line for line in open("/proc/self/maps"))
assert lines <= kneser_ney.OPEN + 1, lines
print("fine")
"""


def test_a_worker_maps_more_files_than_it_may_open(tmp_path):
    import numpy as np

    for i in range(1200):
        np.array([i, 7], np.uint64).tofile(tmp_path / f"range-{i}")
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("fine"), done.stderr
    assert resource.getrlimit(resource.RLIMIT_NOFILE)[0] > 0
