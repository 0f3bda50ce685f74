"""Headline benchmark: prints ONE JSON line.

/root/testdata/sf0.1) on ``local[$BENCH_CPUS]``: exact kNN join 2,000 x 2,000
and against the corpus replicated x10 / x100, MaxSim over hashed token
vectors of the documents, k-means probed search with recall, ML-kNN fit +
predict + multi-label metrics, searched tuple sampling, and the flagship
vote metrics.  Every query is executed fully (a checksum over all columns); seconds, rows,
shuffle bytes and task counts per query come from Spark's event log written
to a private scratch folder.  One untimed warm-up job starts the Python
workers first, as on a long-running cluster.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from vicinity.session import get_spark, ship_package  # noqa: E402


def _replicated_knn(times: int):
    from vicinity.operators.similarity import knn_join
    from vicinity.plans import fixtures as fx

    def run(spark, sf):
        v = fx.vectors(spark, sf).select("pid", "vec")
        corpus = (v.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
                  .select((F.col("pid") * times + F.col("r")).alias("pid"), "vec"))
        return knn_join(v.select(F.col("pid").alias("qid"), "vec"), corpus, 10)
    return run


def bench_queries():
    from vicinity.plans import QUERIES
    return {
        "knn_2k": QUERIES["knn_excl_self"],
        "knn_x10": _replicated_knn(10),
        "knn_x100": _replicated_knn(100),
        "maxsim_hashed": QUERIES["maxsim_hashed"],
        "ivf_recall": QUERIES["kmeans_index_recall"],
        "token_index": QUERIES["token_index_recall"],
        "mlknn_metrics": QUERIES["mlc_metrics_at_k"],
        "nway_tuples": QUERIES["nway_tuples"],
        "vote_metrics": QUERIES["multiclass_metrics"],
    }


def _event_stats(log_dir: str) -> dict:
    """Per job group: shuffle bytes written and number of tasks."""
    stats: dict[str, dict] = {}
    stage_group: dict[int, str] = {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if os.path.isdir(path):
            continue
        with open(path, errors="replace") as f:
            for line in f:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(ev, dict):
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(ev.get("Stage ID"))
                    if not group:
                        continue
                    s = stats.setdefault(group, {"shuffle_bytes": 0, "tasks": 0})
                    tm = ev.get("Task Metrics") or {}
                    s["shuffle_bytes"] += (tm.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    s["tasks"] += 1
    return stats


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:] if not a.startswith("-")]
    scratch = tempfile.mkdtemp(prefix="vicinity-bench-", dir="/tmp")
    log_dir = os.path.join(scratch, "events")
    os.makedirs(log_dir)
    spark = get_spark(f"local[{cpus}]", app="vicinity-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                             "spark.eventLog.compress": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    ship_package(spark)
    # untimed warm-up: starts the JVM code paths and the Python workers the Arrow kernels use
    spark.range(64).mapInArrow(lambda it: it, "id long").agg(F.sum("id")).collect()
    timings, errors, rows, quality = {}, {}, {}, {}
    for name, fn in bench_queries().items():
        if only and name not in only:
            continue
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.time()
        try:
            df = fn(spark, sf)
            # every column feeds the checksum, so nothing is pruned away; one tiny row returns
            aggs = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("h")]
            if "recall" in df.columns:
                aggs.append(F.avg("recall").alias("recall"))
            res = df.agg(*aggs).first()
            timings[name] = round(time.time() - t0, 3)
            rows[name] = int(res["n"])
            if "recall" in df.columns:
                quality[f"{name}_mean_recall"] = round(float(res["recall"]), 4)
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)[:300]
    spark.stop()
    ev = _event_stats(log_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf.rstrip("/").split("sf")[-1],
        "rows": rows,
        "shuffle_bytes": {k: ev.get(k, {}).get("shuffle_bytes") for k in timings},
        "tasks": {k: ev.get(k, {}).get("tasks") for k in timings},
        "cpus": int(cpus),
        "quality": quality,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
