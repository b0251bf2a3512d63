from pyspark.sql import functions as F

from kelpie.common import table
from kelpie.streaming import runs


def test_stream_counts_each_run_once(spark, sf, tmp_path):
    src = table(spark, sf, "ci_runs").filter("started_at IS NOT NULL")
    src.repartition(2).write.parquet(str(tmp_path / "in"))
    q = runs.start(runs.windowed(runs.read(spark, str(tmp_path / "in"), src.schema)), "kelpie_runs", str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.window_start, r.repo): r.n_runs for r in spark.table("kelpie_runs").collect()}
    day = F.window(F.col("started_at").cast("timestamp"), "1 day")["start"]
    once = src.groupBy("ci_run_id").agg(F.min(F.struct(day.alias("d"), "repo")).alias("k"), F.countDistinct(day, "repo").alias("n"))
    assert once.filter("n > 1").isEmpty()  # rows sent again keep their time and repository
    want = {(r.d, r.repo): r.n for r in once.groupBy("k.d", "k.repo").agg(F.count("*").alias("n")).collect()}
    assert len(got) > 10 and got.items() <= want.items()
    left = {k for k in want if k not in got}  # windows that the watermark has not passed
    assert not left or min(d for d, _ in left) > max(d for d, _ in got)
