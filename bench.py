"""Wall time of the headline queries; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("load_rows", "column_profile", "checkpoint_rows", "bm25_topk", "tfidf_cosine",
            "knn_cosine", "rrf_hybrid", "answer_questions", "eval_matrix", "paragraph_text",
            "bm25_term_stats", "client_mentions", "run_state")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from askbase.registry.queries import QUERIES

    spark = (SparkSession.builder.master(f"local[{cores}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cores)
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="askbase-"))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").mapInArrow(  # start the workers, untimed
        lambda batches: batches, "n_nationkey int, n_name string, n_regionkey int").collect()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
