"""What operators leave in a Python worker, each in a process of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
HELD = """
import re
def held():
    text = open("/proc/self/smaps_rollup").read()
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", text))) / 1024
"""


def run(code):
    """The last number that ``code`` prints."""
    made = subprocess.run([sys.executable, "-c", HELD + code], cwd=ROOT, capture_output=True, text=True, check=True)
    return float(made.stdout.split()[-1])


def test_the_encoder_has_one_copy_of_the_vocabulary():
    assert run("""
import public_tokenizers
from shapelog.llm import bpe
text = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
before = held()
encoder = bpe.Encoder(text, 1000)
encoder.encode("a text, and 日本語")
print(held() - before)
""") < 60


def test_a_task_gives_back_what_it_freed():
    """Blocks stay between freed ones, so the allocator by itself keeps some 100 MB."""
    assert run("""
import os
from shapelog.llm.common import released
kept = []
def task(batches):
    made = [os.urandom(5000) for _ in range(20_000)]
    kept.extend(made[::1000])
    kept.append(os.urandom(5000))
    del made
    yield from batches
before = held()
assert list(released(task)([1, 2])) == [1, 2]
print(held() - before)
""") < 30
