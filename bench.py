"""Headline operators timed on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Every query is forced end to end with the no-op sink (full computation,
nothing collected), after one warm-up query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kestrel.session import build_session  # noqa: E402


def _force(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="kestrel-bench", shuffle_partitions=int(cpus) * 2)
    from kestrel.functions.scalar import calendar_parts  # noqa: F401
    from kestrel.ml import cluster as CL
    from kestrel.ml import models as M
    from kestrel.operators import clean as cl
    from kestrel.operators import metrics as mt
    from kestrel.operators import profile as pr
    from kestrel.operators import resample as rs
    from kestrel.operators import timeseries as ts
    from kestrel.plans import fixtures as fx
    from kestrel.sources.tables import Tables

    t = Tables(spark, sf_dir)
    li_num = ["l_quantity", "l_extendedprice", "l_discount"]

    def q_resample_agg():
        _force(rs.resample_agg(t.events, "ts", "1H", ("mean", "max", "min", "std", "median"), "event_type"))

    def q_describe_numeric():
        _force(pr.describe_numeric(t.lineitem))

    def q_outliers_iqr():
        _force(cl.outliers_iqr(t.lineitem, li_num).where("is_outlier"))

    def q_rolling_mean():
        _force(ts.rolling_mean(t.events, "ts", "value", 24, tie="event_id"))

    def q_acf():
        _force(ts.acf(fx.hourly(t), "ts", "value", 48))
        _force(ts.acf(t.events, "ts", "value", 48, series_cols=["user_id"], tie="event_id"))

    def q_corr_spearman():
        al = ts.align_series(t.lineitem, "l_shipdate", "l_quantity", "l_extendedprice")
        ts.corr_spearman(al).collect()

    def q_interpolate():
        r = rs.resample_mean(t.events, "ts", "value", "15T", ["event_type"])
        _force(ts.interpolate_linear(r, "ts", "value", ["event_type"]))

    def q_dedup():
        _force(cl.dedup(fx.events_dups(t)))

    def q_roc_auc():
        mt.roc_auc(fx.pred_binary(t)).collect()

    def q_random_forest_clf():
        li = t.lineitem
        m = M.fit("random_forest_clf", li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")
        _force(M.predict(m, li))

    def q_kmeans():
        e = t.embeddings
        out, _ = CL.kmeans(e, ["embedding"], 10)
        _force(out)

    queries = {k[2:]: v for k, v in locals().items() if k.startswith("q_")}
    only = os.environ.get("BENCH_ONLY")
    if only:
        queries = {k: v for k, v in queries.items() if re.fullmatch(only, k)}
    spark.range(1000).agg(F.sum("id")).collect()  # warm-up
    times = {}
    for name, fn in queries.items():
        s = time.time()
        fn()
        times[name] = round(time.time() - s, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
