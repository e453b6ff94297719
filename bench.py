"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``: one warm-up, then the
median of ``$BENCH_RUNS`` (default 3) timed runs. A run evaluates the whole
result through the ``noop`` sink, so nothing is collected to the driver. With
``BENCH_DUCKDB=1`` the DuckDB time of the same query's oracle SQL is measured
once per query in a process of its own, memory-capped and time-limited, as the
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from concurrent.futures import ProcessPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w11_grade_zones",
    "p11_efficiency_score",
    "w2_clean_points",
    "q1_segment_cut",
    "q3_weather_reference_points",
    "f8_similar_segments",
    "w10_similar_zones",
    "k2_top_by_grade",
    "j11_nearest_way",
    "j12_nearest_forecast",
    "f11_nn_recommendation",
    "a2_completion_fingerprint",
    "j6_reconcile",
    "k1_first_page",
]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _duckdb_time(sql: str, sf_dir: str, limit_s: float = 120.0) -> float | None:
    """Time the oracle SQL in DuckDB (memory-capped, interrupted after ``limit_s``); None if it does not finish."""
    try:
        import duckdb
    except ImportError:
        return None
    import threading
    con = duckdb.connect()
    con.execute(f"SET threads TO {os.environ.get('BENCH_CPUS', '4')}")
    con.execute(f"SET memory_limit = '{os.environ.get('BENCH_DUCKDB_MEMORY', '6GB')}'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    timer = threading.Timer(limit_s, con.interrupt)
    timer.start()
    t0 = time.time()
    try:
        con.execute(f"SELECT count(*) FROM ({sql})").fetchall()
        return round(time.time() - t0, 3)
    except Exception:  # noqa: BLE001
        return None
    finally:
        timer.cancel()
        con.close()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    with_duckdb = os.environ.get("BENCH_DUCKDB", "0") == "1"
    from segspark.plans.registry import oracles, queries
    from segspark.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="segspark-bench")
    qs, sqls = queries(), oracles()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in qs]
    timings, duck, errors = {}, {}, {}
    for name in names:
        samples = []
        try:
            for i in range(runs + 1):
                t0 = time.time()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i > 0:
                    samples.append(time.time() - t0)
                spark.catalog.clearCache()
            timings[name] = round(statistics.median(samples), 3)
            print(f"[bench] {name}: {timings[name]}s (runs {[round(x, 2) for x in samples]})", file=sys.stderr,
                  flush=True)
        except Exception as e:  # noqa: BLE001
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    spark.stop()
    if with_duckdb:
        for name in timings:
            if name in sqls:
                with ProcessPoolExecutor(1) as pool:  # its memory goes with it
                    duck[name] = pool.submit(_duckdb_time, sqls[name], sf_dir).result()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
           "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
           "runs": runs, "duckdb_oracle_sec": duck}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
