"""A Python worker gives memory back once its rows are done."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

HELD = """
import gc, re
import pyarrow as pa
from entityspark.llm import jaccard
from entityspark.llm.textio import steps, texts

def mb():
    return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(3):
        found = [" ".join(f"w{(k + i * 7919 + j * 31) % 50021}" for j in range(500)) for i in range(4000)]
        sink = pa.BufferOutputStream()
        made = pa.record_batch([pa.array(found)], names=["t"])
        with pa.ipc.new_stream(sink, made.schema) as out:
            out.write_batch(made)
        yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()

def run():
    for batch in steps(batches(), "t"):
        found = [jaccard.shingles(t, 5) for t in texts(batch, "t")]
        yield pa.RecordBatch.from_arrays([jaccard._lists([jaccard._sketch(x) for x in found]), jaccard._lists(found)], names=["s", "h"])

before = mb()
for result in run():
    pass
del result
gc.collect()
print(mb() - before)
"""


def test_freed_memory_goes_back():
    done = subprocess.run([sys.executable, "-c", HELD], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    assert float(done.stdout) < 105, done.stdout
