"""Hot keys: with a third of the rows on one phone (or one handset), no
task of a data-carrying stage reads much more than its fair share of
shuffle records; a plan that gathers the hot key in one task is caught.
Runs tools/skew_check.py in its own process (it needs an event log)."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_hot_keys_are_spread():
    out = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "skew_check.py"), "/root/testdata/sf0.01"],
                         capture_output=True, text=True, timeout=1200, cwd=ROOT)
    line = [x for x in out.stdout.splitlines() if x.startswith("{")][-1]
    shares = json.loads(line)["max_task_share"]
    assert shares.pop("naive_repartition_by_phone") > 0.3      # the check can see skew
    assert shares.pop("naive_window_by_class") > 0.5
    for name, share in shares.items():
        assert share < 0.25, (name, share)                     # 8 tasks: fair share 0.125
