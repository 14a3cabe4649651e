import shutil

import pyarrow.parquet as pq

from tidemark.settings import Settings
from tidemark.sources.readers import stream_log
from tidemark.streaming.live import clean_stream, daily_counts, new_items, sessions

DIR = "/root/testdata/sf0.001"


def live(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream_log(spark, DIR).write.parquet(str(tmp_path / "in/a"))
    for f in (tmp_path / "in/a").glob("*.parquet"):
        shutil.move(f, tmp_path / "in" / f.name)
    shutil.rmtree(tmp_path / "in/a")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drain(df, tmp_path, name, mode="append"):
    out = str(tmp_path / name)
    if mode == "append":
        df.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
        return pq.read_table(out).to_pylist()
    rows = []
    df.writeStream.outputMode(mode).option("checkpointLocation", out + "-c").trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(r.asDict() for r in b.collect())).start().awaitTermination()
    return rows


def test_streams_agree_with_batch(spark, tmp_path):
    df = live(spark, tmp_path)
    batch = stream_log(spark, DIR).where("event_type in ('view', 'cart', 'purchase') and user_id is not null and product_id is not null")
    clean = drain(clean_stream(df, Settings()), tmp_path, "clean")
    assert len(clean) == batch.dropDuplicates(["user_id", "product_id", "event_type", "event_time"]).count()
    counts = drain(daily_counts(df), tmp_path, "daily", "complete")
    assert sum(r["n"] for r in counts) == stream_log(spark, DIR).count()
    assert sum(r["n"] for r in drain(sessions(df), tmp_path, "sessions", "complete")) == stream_log(spark, DIR).where("user_id is not null").count()
    seen = drain(new_items(df.where("product_id is not null")), tmp_path, "seen")
    assert len(seen) == batch.sparkSession.createDataFrame(seen).distinct().count() == stream_log(spark, DIR).where("product_id is not null").select("user_id", "product_id").distinct().count()
