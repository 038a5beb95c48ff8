"""Memory that executors hold between steps; needs executors of their own, so the session runs in a process of its own."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = r"""
import re, sys, time
from pathlib import Path
from pyspark.sql import SparkSession, functions as F

sys.path.insert(0, sys.argv[1])
from colform.llm.shared import Workspace

spark = (
    SparkSession.builder.master("local-cluster[2,2,1400]").config("spark.executor.memory", "1000m").config("spark.ui.enabled", "false")
    .config("spark.executor.extraJavaOptions", "-XX:ActiveProcessorCount=2").config("spark.checkpoint.dir", f"file://{sys.argv[2]}/shared").getOrCreate()
)

def held():
    out = []
    for p in Path("/proc").glob("[0-9]*"):
        try:
            command = (p / "cmdline").read_bytes()
            if sys.argv[2].encode() in command and command.split(b"\x00")[0].endswith(b"java") and b"CoarseGrainedExecutorBackend" in command:
                out.append(int(re.search(r"VmRSS:\s+(\d+)", (p / "status").read_text())[1]) / 1024)
        except (OSError, TypeError):
            pass
    return sum(out)

words = spark.range(0, 400_000, 1, 8).select("id", F.repeat(F.col("id").cast("string"), 150).alias("text"))
words.repartition(4, "text").sortWithinPartitions("text").groupBy(F.col("id") % 4).agg(F.collect_list(F.when(F.col("id") % 8 < 2, F.col("text"))).alias("texts")).select(F.sum(F.size("texts"))).first()
before = held()
Workspace(spark, "memory").release()
until = time.time() + 10
while held() > 0.75 * before and time.time() < until:  # the collector gives regions back little by little
    time.sleep(0.2)
print("held", before, held())
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads /proc")
def test_release_lets_executors_give_back_their_heap(tmp_path):
    import pyspark

    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(Path(__file__).resolve().parents[2]), str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    line = [x for x in run.stdout.splitlines() if x.startswith("held")]
    assert line, run.stderr[-2000:]
    before, after = map(float, line[0].split()[1:])
    assert 0 < after <= 0.75 * before, (before, after)
