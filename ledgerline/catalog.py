"""The reconciliation queries over the test tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canon import canon
from .operators import bounds, predicates
from .operators import diff as d
from .operators.checksum import checksum, hashed
from .operators.lag import cutoff, recheck
from .plans import mirror
from .plans.compare import compare, compared_columns
from .plans.config import Comparison
from .plans.report import plain

TABLES = {
    "orders": (["o_orderkey"], {"o_custkey": "i", "o_orderdate": "t", "o_orderpriority": "s", "o_orderstatus": "s", "o_totalprice": "f"}),
    "events": (["event_id"], {"event_type": "s", "props": "s", "ts": "t", "user_id": "i", "value": "f"}),
    "customer": (["c_custkey"], {"c_acctbal": "f", "c_mktsegment": "s", "c_name": "s", "c_nationkey": "i"}),
    "part": (["p_partkey"], {"p_brand": "s", "p_name": "s", "p_retailprice": "f", "p_size": "i", "p_type": "s"}),
    "supplier": (["s_suppkey"], {"s_acctbal": "f", "s_name": "s", "s_nationkey": "i"}),
    "documents": (["doc_id"], {"lang": "s", "n_chars": "i", "source": "s", "text": "s"}),
    "nation": (["n_nationkey"], {"n_name": "s", "n_regionkey": "i"}),
    "conversations": (["conv_id", "turn"], {"role": "s", "text": "s"}),
    "lineitem": (["l_orderkey", "l_linenumber"], {"l_extendedprice": "f", "l_quantity": "f", "l_shipdate": "t"}),
}
CUTOFF = datetime.datetime(2024, 1, 20)
_SQL = {"i": "CAST({c} AS VARCHAR)", "s": "{c}", "t": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')", "f": "printf('%.17g', {c})"}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _mirror(spark: SparkSession, sf: str, name: str, sql: str | None = None) -> DataFrame:
    sql = sql or {"orders": mirror.ORDERS, "events": mirror.EVENTS, "conversations": mirror.CONVERSATIONS}[name]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=_table(spark, sf, name))


def _hashed(df: DataFrame, name: str, only=None) -> DataFrame:
    pk, columns = TABLES[name]
    return hashed(df, pk, only if only is not None else sorted(columns))


def _hash_sql(name: str, only=None) -> str:
    pk, columns = TABLES[name]
    texts = [f"coalesce({_SQL[columns.get(c, 'i')].format(c=c)}, '\\N')" for c in [*pk, *(only if only is not None else sorted(columns))]]
    return f"('0x' || substr(md5(concat_ws(chr(31), {', '.join(texts)})), 1, 15))::BIGINT"


def _rows_sql(name: str, body: str | None = None, where: str = "true", only=None) -> str:
    pk = TABLES[name][0]
    return f"SELECT {', '.join(pk)}, {_hash_sql(name, only)} AS row_hash FROM ({body or f'SELECT * FROM {name}'}) WHERE {where}"


def _diff_sql(name: str, source: str, target: str, where: str = "true") -> str:
    pk = TABLES[name][0]
    keys = ", ".join(pk)
    return f"""WITH a AS (SELECT {keys}, max(row_hash) AS h FROM ({source}) GROUP BY ALL), b AS (SELECT {keys}, max(row_hash) AS h FROM ({target}) GROUP BY ALL),
    j AS (SELECT {keys}, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'extra' WHEN a.h <> b.h THEN 'changed' END AS kind FROM a FULL JOIN b USING ({keys}))
    SELECT {keys}, kind FROM j WHERE kind IS NOT NULL AND {where}"""


ORDERS_DIFF = _diff_sql("orders", _rows_sql("orders"), _rows_sql("orders", mirror.ORDERS))
_COUNTS = "SELECT k AS kind, count(kind)::BIGINT AS n FROM (VALUES ('missing'), ('extra'), ('changed')) v(k) LEFT JOIN ({q}) ON k = kind GROUP BY k"


def _pair(spark, sf, name="orders", only=None):
    return _hashed(_table(spark, sf, name), name, only), _hashed(_mirror(spark, sf, name), name, only)


def diff_orders(spark, sf):
    return d.diff(*_pair(spark, sf), ["o_orderkey"])


def _counts(drift: DataFrame) -> DataFrame:
    kinds = drift.sparkSession.createDataFrame([(k,) for k in d.KINDS], "kind string")
    return kinds.join(drift.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def _of_kind(kind):
    return lambda spark, sf: diff_orders(spark, sf).where(F.col("kind") == kind).select("o_orderkey")


def _emptied(source: bool, target: bool):
    def query(spark, sf):
        a, b = _pair(spark, sf)
        return _counts(d.diff(a.where("1 = 0") if source else a, b.where("1 = 0") if target else b, ["o_orderkey"]))

    return query


def _columns(**how):
    def query(spark, sf):
        a, b = _table(spark, sf, "orders"), _mirror(spark, sf, "orders").withColumn("only_here", F.lit(1))
        columns = compared_columns(a, b, ["o_orderkey"], how.get("listed"), how.get("excluded", []))
        return d.diff(hashed(a, ["o_orderkey"], columns), hashed(b, ["o_orderkey"], columns), ["o_orderkey"])

    return query


def _column_sql(only):
    return _diff_sql("orders", _rows_sql("orders", only=only), _rows_sql("orders", mirror.ORDERS, only=only))


def diff_string_key(spark, sf):
    key = F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("doc_key")
    a = _table(spark, sf, "documents").select(key, "lang", "source", "text", "doc_id")
    b = a.where("doc_id % 71 <> 3").withColumn("lang", F.when(F.col("doc_id") % 43 == 1, "xx").otherwise(F.col("lang")))
    return d.diff(*(hashed(x, ["doc_key"], ["lang", "source", "text"]) for x in (a, b)), ["doc_key"])


def diff_duplicate_keys(spark, sf):
    rows = _table(spark, sf, "lineitem")
    return d.diff(_hashed(rows, "lineitem"), _hashed(rows.where("l_partkey % 89 <> 6"), "lineitem"), TABLES["lineitem"][0])


_EDGE_A = "SELECT * FROM (VALUES (1, 'a', 'x'), (2, CAST(NULL AS STRING), 'y'), (3, 'c', 'z'), (4, '', 'w')) v(id, p, q)"
_EDGE_B = "SELECT * FROM (VALUES (1, 'x', 'a'), (2, 'b', 'y'), (3, 'c', 'z'), (4, CAST(NULL AS STRING), 'w')) v(id, p, q)"


def diff_nulls_and_swaps(spark, sf):
    return d.diff(*(hashed(spark.sql(q), ["id"], ["p", "q"]) for q in (_EDGE_A, _EDGE_B)), ["id"])


def _checksum(of):
    return lambda spark, sf: checksum(_hashed(of(_table(spark, sf, "orders")), "orders"))


_CHECK = "SELECT count(*)::BIGINT AS rows, coalesce(sum(row_hash::HUGEINT) % 9223372036854775808, 0)::BIGINT AS checksum FROM ({q})"
_TABLES_CANON = {
    "bool": ("CAST(v AS BOOLEAN)", "(true), (false), (NULL)", "CASE WHEN v THEN '1' WHEN NOT v THEN '0' END"),
    "int": ("CAST(v AS BIGINT)", "(0), (-7), (9223372036854775807), (NULL)", "CAST(v AS VARCHAR)"),
    "decimal": ("CAST(v AS DECIMAL(20,10))", "('1.2300'), ('100'), ('0'), ('-12.340'), (NULL)", "rtrim(rtrim(CAST(CAST(v AS DECIMAL(20,10)) AS VARCHAR), '0'), '.')"),
    "double17": ("CAST(v AS DOUBLE)", "('0.1'), ('1e20'), ('-2.5'), ('1e-7'), ('123456.789'), (NULL)", "printf('%.17g', CAST(v AS DOUBLE))"),
    "double12": ("CAST(v AS DOUBLE)", "('0.1'), ('1e20'), ('0.3333333333333333'), ('6.022e23'), (NULL)", "printf('%.12g', CAST(v AS DOUBLE))"),
    "timestamp": ("CAST(v AS TIMESTAMP_NTZ)", "('2024-01-02 03:04:05.678901'), ('0099-12-31 00:00:00'), (NULL)", "CASE v WHEN '0099-12-31 00:00:00' THEN '0099-12-31 00:00:00.000000' ELSE strftime(CAST(v AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') END"),
    "date": ("CAST(v AS DATE)", "('2024-02-29'), (NULL)", "CAST(CAST(v AS DATE) AS VARCHAR)"),
    "binary": ("CAST(v AS BINARY)", "('abc'), (''), (NULL)", "lower(hex(v::BLOB))"),
    "text": ("v", "('café'), (''), ('a b'), (NULL)", "v"),
}


def _canon(name):
    cast, values, _ = _TABLES_CANON[name]

    def query(spark, sf):
        df = spark.sql(f"SELECT {cast} AS v FROM (VALUES {values}) t(v)")
        return df.select(F.coalesce(canon(F.col("v"), df.schema["v"].dataType, 12 if name == "double12" else 17), F.lit("\\N")).alias("text"))

    return query


def _bucketed(df: DataFrame, top: int, n: int = 16) -> DataFrame:
    lo, _ = bounds.child(F.col("o_orderkey"), F.lit(0), F.lit(top), n)
    return df.withColumn("segment", lo)


def _top(spark, sf):
    a, b = _table(spark, sf, "orders"), _mirror(spark, sf, "orders")
    return max(bounds.pk_bounds(x, ["o_orderkey"])[1][0] for x in (a, b)) + 1


def checksum_by_segment(spark, sf):
    top = bounds.pk_bounds(_table(spark, sf, "orders"), ["o_orderkey"])[1][0] + 1
    return checksum(_bucketed(_hashed(_table(spark, sf, "orders"), "orders"), top), "segment")


def dirty_segments(spark, sf):
    top = _top(spark, sf)
    a, b = (checksum(_bucketed(x, top, 64), "segment") for x in _pair(spark, sf))
    both = a.join(b.withColumnRenamed("rows", "r").withColumnRenamed("checksum", "c"), "segment", "full_outer")
    return both.where(~(F.col("rows").eqNullSafe(F.col("r")) & F.col("checksum").eqNullSafe(F.col("c")))).select("segment")


def _segment_sql(top: str, n: int) -> str:
    return f"(({top}) * ((((o_orderkey + 1) * {n}) - 1) // ({top}))) // {n}"


def _bounds(name, where=None):
    pk = TABLES[name][0]

    def query(spark, sf):
        df = _table(spark, sf, name)
        found = bounds.pk_bounds(predicates.settled(df, "ts", CUTOFF) if where else df, pk)
        return spark.createDataFrame([(e, *map(int, k)) for e, k in zip(("lo", "hi"), found)], "edge string, " + ", ".join(f"{c} long" for c in pk))

    return query


def _bounds_sql(name, where="true"):
    keys = ", ".join(TABLES[name][0])
    down = ", ".join(f"{c} DESC" for c in TABLES[name][0])
    return f"(SELECT 'lo' AS edge, {keys} FROM {name} WHERE {where} ORDER BY {keys} LIMIT 1) UNION ALL (SELECT 'hi', {keys} FROM {name} WHERE {where} ORDER BY {down} LIMIT 1)"


def int_split(spark, sf):
    lo, hi = (k[0] for k in bounds.pk_bounds(_table(spark, sf, "orders"), ["o_orderkey"]))
    return spark.createDataFrame([(b,) for b in bounds.boundaries(lo, hi + 1, 16)], "boundary long")


def _points(make, pk, n=16):
    return lambda spark, sf: bounds.split_points(make(spark, sf), pk, n)


def _points_sql(body, pk, n=16):
    keys = ", ".join(pk)
    return f"""WITH r AS (SELECT {keys}, row_number() OVER (ORDER BY {keys}) - 1 AS rank, count(*) OVER () AS total FROM ({body})),
    lowest AS (SELECT {keys} FROM r WHERE rank = 0)
    SELECT DISTINCT {keys} FROM r WHERE rank IN (SELECT (SELECT max(total) FROM r) * i // {n} FROM range(1, {n}) t(i)) AND ({keys}) NOT IN (SELECT ({keys}) FROM lowest)"""


def _doc_keys(spark, sf):
    return _table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("doc_key"))


def row_hashes_for_keys(spark, sf):
    orders = _table(spark, sf, "orders")
    return _hashed(predicates.with_keys(orders, diff_orders(spark, sf), ["o_orderkey"]), "orders")


def _events(mode):
    def query(spark, sf):
        a, b = _table(spark, sf, "events"), _mirror(spark, sf, "events")
        if mode == "inflight":
            return predicates.in_flight(a, ["event_id"], "ts", CUTOFF)
        cut = None if mode == "no_grace" else CUTOFF
        flying = predicates.in_flight(a, ["event_id"], "ts", cut)
        return d.diff(*(_hashed(predicates.settled(x, "ts", cut), "events") for x in (a, b)), ["event_id"], flying)

    return query


_EVENT_CUT = "ts <= TIMESTAMP '2024-01-20 00:00:00'"


def recheck_reconciled(spark, sf):
    later = lambda: (_hashed(_table(spark, sf, "orders"), "orders"), _hashed(_mirror(spark, sf, "orders", mirror.ORDERS_LATER), "orders"))
    return recheck(diff_orders(spark, sf), ["o_orderkey"], later, 0, 1)


def _segments(name):
    def query(spark, sf):
        cmp = Comparison(name, name, name, TABLES[name][0], segment_fanout=16, leaf_size=200, recheck_rounds=0)
        report = compare(lambda: _table(spark, sf, name), lambda: _mirror(spark, sf, name), cmp)
        return report.drift

    return query


_STATS = "segments_scanned long, rows_compared long, drift_total long"


def _stats(load, **how):
    """Counters of a comparison of what ``load`` gives: (segments_scanned, rows_compared, drift_total)."""

    def query(spark, sf):
        a, b, pk = load(spark, sf)
        report = compare(lambda: a, lambda: b, Comparison("t", "a", "b", pk, recheck_rounds=0, **how))
        report.release()
        return spark.createDataFrame([(report.segments_scanned, report.rows_compared, report.drift_total)], _STATS)

    return query


def _orders_pair(spark, sf):
    return _table(spark, sf, "orders"), _mirror(spark, sf, "orders"), ["o_orderkey"]


def _healthy(spark, sf):
    return _table(spark, sf, "orders"), _table(spark, sf, "orders"), ["o_orderkey"]


def _lineitem_against_none(spark, sf):
    rows = _table(spark, sf, "lineitem")
    return rows, rows.where("1 = 0"), TABLES["lineitem"][0]


def diff_mixed_key_types(spark, sf):
    """Decimal keys here, long ones there: equal numbers are equal keys."""
    a, b, pk = _orders_pair(spark, sf)
    a = a.withColumn("o_orderkey", F.col("o_orderkey").cast("decimal(12,2)"))
    report = compare(lambda: a, lambda: b, Comparison("t", "a", "b", pk, recheck_rounds=0, strategy="join"))
    return report.drift.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "kind")


def report_summary(spark, sf):
    a, b, pk = _orders_pair(spark, sf)
    told = compare(lambda: a, lambda: b, Comparison("orders", "a", "b", pk, recheck_rounds=0, strategy="join")).summary()
    kinds = told["drift_by_kind"]
    row = [told["comparison"], told["in_sync"], told["drift_total"], *(kinds[k] for k in d.KINDS), ",".join(kinds)]
    return spark.createDataFrame([row], "comparison string, in_sync boolean, drift_total long, missing long, extra long, changed long, kinds string")


def report_json_keys(spark, sf):
    """The first keys as the JSON report has them: dates as ISO text, decimals plain."""
    keyed = lambda df: df.select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").cast("decimal(12,2)").alias("n"), "o_totalprice")
    a, b, _ = _orders_pair(spark, sf)
    found = compare(lambda: keyed(a), lambda: keyed(b), Comparison("t", "a", "b", ["day", "n"], recheck_rounds=0, strategy="join"))
    rows = [(i, json.dumps([plain(v) for v in key]), kind) for i, (key, kind) in enumerate(found.keys(20))]
    found.release()
    return spark.createDataFrame(rows, "place long, key string, kind string")


def cutoff_capture(spark, sf):
    """Events that a run started an hour after the cutoff, with an hour of grace, finds settled."""
    at = cutoff("ts", 3600, CUTOFF.replace(hour=1, tzinfo=datetime.timezone.utc))
    return predicates.settled(_table(spark, sf, "events"), "ts", at).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def _walk_sql(source: str, target: str, key: str, fan: int, leaf: int, levels: int = 8) -> str:
    """The walk level by level, as range joins: (segments_scanned, rows_compared, drift_total)."""
    total = "coalesce(sum(row_hash::HUGEINT) FILTER (side = {0}), 0) % 9223372036854775808"
    parts = [f"""WITH r AS (SELECT {key} AS k, row_hash, 0 AS side FROM ({source}) UNION ALL SELECT {key}, row_hash, 1 FROM ({target})),
    s0 AS (SELECT min(k) AS lo, max(k) + 1 AS hi FROM r)"""]
    for n in range(levels):
        parts.append(f"""c{n} AS (SELECT lo, hi, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1, {total.format(0)} AS h0, {total.format(1)} AS h1
        FROM s{n} LEFT JOIN r ON k >= lo AND k < hi GROUP BY lo, hi)""")
        parts.append(f"o{n} AS (SELECT *, greatest(n0, n1) > {leaf} AND hi - lo > 1 AS large FROM c{n} WHERE n0 <> n1 OR h0 <> h1)")
        edge = f"lo + (hi - lo) * (i + {{}}) // {fan}"
        parts.append(f"s{n + 1} AS (SELECT DISTINCT {edge.format(0)} AS lo, {edge.format(1)} AS hi FROM o{n}, range({fan}) x(i) WHERE large AND {edge.format(0)} < {edge.format(1)})")
    leaves = " UNION ALL ".join(f"SELECT lo, hi FROM o{n} WHERE NOT large" for n in range(levels))
    scanned = " + ".join(f"(SELECT count(*) FROM s{n})" for n in range(levels))
    return ", ".join(parts) + f""", leaves AS ({leaves}), kept AS (SELECT k, max(row_hash) FILTER (side = 0) AS a, max(row_hash) FILTER (side = 1) AS b FROM r JOIN leaves ON k >= lo AND k < hi GROUP BY k)
    SELECT ({scanned})::BIGINT AS segments_scanned, (SELECT count(*) FROM kept)::BIGINT AS rows_compared, (SELECT count(*) FROM kept WHERE a IS DISTINCT FROM b)::BIGINT AS drift_total"""


def report_sample(spark, sf):
    return diff_orders(spark, sf).orderBy("o_orderkey").limit(20)


_DOC_A = "SELECT lpad(doc_id::VARCHAR, 10, '0') AS doc_key, lang, source, text, doc_id FROM documents"
_DOC_B = f"SELECT doc_key, CASE WHEN doc_id % 43 = 1 THEN 'xx' ELSE lang END AS lang, source, text FROM ({_DOC_A}) WHERE doc_id % 71 <> 3"
_DOC_HASH = "SELECT doc_key, ('0x' || substr(md5(concat_ws(chr(31), doc_key, coalesce(lang, '\\N'), coalesce(source, '\\N'), coalesce(text, '\\N'))), 1, 15))::BIGINT AS row_hash FROM ({q})"
_EDGE_HASH = "SELECT id, ('0x' || substr(md5(concat_ws(chr(31), id::VARCHAR, coalesce(p, '\\N'), coalesce(q, '\\N'))), 1, 15))::BIGINT AS row_hash FROM ({q})"


def _diff_sql_pk(pk: str, source: str, target: str) -> str:
    return f"""WITH a AS ({source}), b AS ({target}),
    j AS (SELECT {pk}, CASE WHEN b.row_hash IS NULL THEN 'missing' WHEN a.row_hash IS NULL THEN 'extra' WHEN a.row_hash <> b.row_hash THEN 'changed' END AS kind FROM a FULL JOIN b USING ({pk}))
    SELECT {pk}, kind FROM j WHERE kind IS NOT NULL"""


def _catalog():
    orders, pk = _rows_sql("orders"), ["o_orderkey"]
    top_both = "(SELECT greatest((SELECT max(o_orderkey) FROM orders), (SELECT max(o_orderkey) FROM (" + mirror.ORDERS + "))) + 1)"
    top_own = "(SELECT max(o_orderkey) + 1 FROM orders)"
    events = lambda where="true": _diff_sql("events", _rows_sql("events", where=where), _rows_sql("events", mirror.EVENTS, where))
    flying = "event_id NOT IN (SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00')"
    out = {
        "diff_orders": (diff_orders, ORDERS_DIFF),
        "diff_orders_counts": (lambda s, f: _counts(diff_orders(s, f)), _COUNTS.format(q=ORDERS_DIFF)),
        **{f"diff_{k}": (_of_kind(k), f"SELECT o_orderkey FROM ({ORDERS_DIFF}) WHERE kind = '{k}'") for k in d.KINDS},
        "diff_source_empty": (_emptied(True, False), _COUNTS.format(q=_diff_sql("orders", orders + " AND 1 = 0", _rows_sql("orders", mirror.ORDERS)))),
        "diff_target_empty": (_emptied(False, True), _COUNTS.format(q=_diff_sql("orders", orders, _rows_sql("orders", mirror.ORDERS, "1 = 0")))),
        "diff_both_empty": (_emptied(True, True), _COUNTS.format(q=_diff_sql("orders", orders + " AND 1 = 0", orders + " AND 1 = 0"))),
        "diff_in_sync": (lambda s, f: _counts(d.diff(_pair(s, f)[0], _pair(s, f)[0], pk)), _COUNTS.format(q=_diff_sql("orders", orders, orders))),
        "diff_composite_conversations": (
            lambda s, f: d.diff(*_pair(s, f, "conversations"), ["conv_id", "turn"]),
            _diff_sql("conversations", _rows_sql("conversations"), _rows_sql("conversations", mirror.CONVERSATIONS)),
        ),
        "diff_string_key": (diff_string_key, _diff_sql_pk("doc_key", _DOC_HASH.format(q=_DOC_A), _DOC_HASH.format(q=_DOC_B))),
        "diff_exclude_columns": (_columns(excluded=["o_totalprice"]), _column_sql(["o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"])),
        "diff_explicit_columns": (_columns(listed=["o_totalprice", "O_OrderStatus"]), _column_sql(["o_orderstatus", "o_totalprice"])),
        "diff_star_intersection": (_columns(), ORDERS_DIFF),
        "diff_nulls_and_swaps": (diff_nulls_and_swaps, _diff_sql_pk("id", _EDGE_HASH.format(q=_EDGE_A), _EDGE_HASH.format(q=_EDGE_B))),
        "diff_duplicate_keys_lineitem": (diff_duplicate_keys, _diff_sql("lineitem", _rows_sql("lineitem"), _rows_sql("lineitem", where="l_partkey % 89 <> 6"))),
        **{f"row_hash_{t}": (lambda s, f, t=t: _hashed(_table(s, f, t), t), _rows_sql(t)) for t in ("orders", "events", "customer", "part", "supplier", "documents", "nation", "conversations")},
        **{f"canon_{n}": (_canon(n), f"SELECT coalesce({sql}, '\\N') AS text FROM (VALUES {values}) t(v)") for n, (_, values, sql) in _TABLES_CANON.items()},
        "checksum_full": (_checksum(lambda x: x), _CHECK.format(q=orders)),
        "checksum_range": (_checksum(lambda x: predicates.in_range(x, pk, (100,), (1000,))), _CHECK.format(q=orders + " AND o_orderkey >= 100 AND o_orderkey < 1000")),
        "checksum_empty": (_checksum(lambda x: predicates.in_range(x, pk, (5,), (5,))), _CHECK.format(q=orders + " AND 1 = 0")),
        "checksum_cutoff": (lambda s, f: checksum(_hashed(predicates.settled(_table(s, f, "events"), "ts", CUTOFF), "events")), _CHECK.format(q=_rows_sql("events", where=_EVENT_CUT))),
        "checksum_composite_range": (
            lambda s, f: checksum(_hashed(predicates.in_range(_table(s, f, "conversations"), ["conv_id", "turn"], (2, 1), (20, 3)), "conversations")),
            _CHECK.format(q=_rows_sql("conversations", where="(conv_id > 2 OR conv_id = 2 AND turn >= 1) AND (conv_id < 20 OR conv_id = 20 AND turn < 3)")),
        ),
        "checksum_by_segment": (
            checksum_by_segment,
            f"SELECT {_segment_sql(top_own, 16)} AS segment, count(*)::BIGINT AS rows, (sum(row_hash::HUGEINT) % 9223372036854775808)::BIGINT AS checksum FROM ({orders}) GROUP BY 1",
        ),
        "dirty_segments": (dirty_segments, f"""WITH a AS (SELECT {_segment_sql(top_both, 64)} AS segment, count(*) AS r, sum(row_hash::HUGEINT) AS c FROM ({orders}) GROUP BY 1),
            b AS (SELECT {_segment_sql(top_both, 64)} AS segment, count(*) AS r, sum(row_hash::HUGEINT) AS c FROM ({_rows_sql('orders', mirror.ORDERS)}) GROUP BY 1)
            SELECT segment::BIGINT AS segment FROM a FULL JOIN b USING (segment) WHERE a.r IS DISTINCT FROM b.r OR a.c IS DISTINCT FROM b.c"""),
        "pk_bounds_int": (_bounds("orders"), _bounds_sql("orders")),
        "pk_bounds_composite": (_bounds("conversations"), _bounds_sql("conversations")),
        "pk_bounds_cutoff": (_bounds("events", True), _bounds_sql("events", _EVENT_CUT)),
        "int_split": (int_split, "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) + 1 AS hi FROM orders) SELECT DISTINCT lo + (hi - lo) * i // 16 AS boundary FROM b, range(17) t(i)"),
        "split_points_int": (_points(lambda s, f: _table(s, f, "orders"), pk), _points_sql("SELECT * FROM orders", pk)),
        "split_points_string": (_points(_doc_keys, ["doc_key"]), _points_sql(_DOC_A, ["doc_key"])),
        "split_points_composite": (_points(lambda s, f: _table(s, f, "conversations"), ["conv_id", "turn"]), _points_sql("SELECT * FROM conversations", ["conv_id", "turn"])),
        "row_hashes_range": (lambda s, f: _hashed(predicates.in_range(_table(s, f, "orders"), pk, (50,), (200,)), "orders"), orders + " AND o_orderkey >= 50 AND o_orderkey < 200"),
        "row_hashes_for_keys": (row_hashes_for_keys, _rows_sql("orders", where=f"o_orderkey IN (SELECT o_orderkey FROM ({ORDERS_DIFF}))")),
        "in_flight_events": (_events("inflight"), "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'"),
        "diff_events_cutoff": (_events("cutoff"), f"SELECT * FROM ({events(_EVENT_CUT)}) WHERE {flying}"),
        "diff_events_no_grace": (_events("no_grace"), events()),
        "recheck_reconciled": (recheck_reconciled, f"SELECT l.* FROM ({_diff_sql('orders', orders, _rows_sql('orders', mirror.ORDERS_LATER))}) l WHERE o_orderkey IN (SELECT o_orderkey FROM ({ORDERS_DIFF}))"),
        "segment_diff_orders": (_segments("orders"), ORDERS_DIFF),
        "segment_diff_conversations": (_segments("conversations"), _diff_sql("conversations", _rows_sql("conversations"), _rows_sql("conversations", mirror.CONVERSATIONS))),
        "segment_stats": (_stats(_orders_pair, segment_fanout=16, leaf_size=200), _walk_sql(orders, _rows_sql("orders", mirror.ORDERS), "o_orderkey", 16, 200)),
        "segment_stats_narrow": (_stats(_orders_pair, segment_fanout=4, leaf_size=1000), _walk_sql(orders, _rows_sql("orders", mirror.ORDERS), "o_orderkey", 4, 1000, 12)),
        "verify_healthy": (_stats(_healthy), "SELECT 1::BIGINT AS segments_scanned, 0::BIGINT AS rows_compared, 0::BIGINT AS drift_total"),
        "rows_examined_join": (
            _stats(_orders_pair, strategy="join"),
            f"SELECT 1::BIGINT AS segments_scanned, (SELECT count(*) FROM (SELECT o_orderkey FROM orders UNION SELECT o_orderkey FROM ({mirror.ORDERS})))::BIGINT AS rows_compared, (SELECT count(*) FROM ({ORDERS_DIFF}))::BIGINT AS drift_total",
        ),
        "rows_examined_one_side_empty": (
            _stats(_lineitem_against_none),
            "SELECT 1::BIGINT AS segments_scanned, count(*)::BIGINT AS rows_compared, count(*)::BIGINT AS drift_total FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
        ),
        "diff_mixed_key_types": (diff_mixed_key_types, ORDERS_DIFF),
        "report_summary": (report_summary, f"""SELECT 'orders' AS comparison, count(*) = 0 AS in_sync, count(*)::BIGINT AS drift_total, (count(*) FILTER (kind = 'missing'))::BIGINT AS missing,
            (count(*) FILTER (kind = 'extra'))::BIGINT AS extra, (count(*) FILTER (kind = 'changed'))::BIGINT AS changed, 'missing,extra,changed' AS kinds FROM ({ORDERS_DIFF})"""),
        "report_json_keys": (report_json_keys, f"""WITH a AS (SELECT o_orderdate::DATE AS day, o_orderkey AS n, o_totalprice AS p FROM orders), b AS (SELECT o_orderdate::DATE AS day, o_orderkey AS n, o_totalprice AS p FROM ({mirror.ORDERS})),
            j AS (SELECT day, n, CASE WHEN b.p IS NULL THEN 'missing' WHEN a.p IS NULL THEN 'extra' WHEN a.p <> b.p THEN 'changed' END AS kind FROM a FULL JOIN b USING (day, n))
            SELECT row_number() OVER (ORDER BY day, n) - 1 AS place, '["' || strftime(day, '%Y-%m-%d') || '", "' || n || '"]' AS key, kind FROM j WHERE kind IS NOT NULL ORDER BY day, n LIMIT 20"""),
        "cutoff_capture": (cutoff_capture, f"SELECT count(*)::BIGINT AS n, max(ts) AS last FROM events WHERE {_EVENT_CUT}"),
        "report_sample": (report_sample, f"SELECT * FROM ({ORDERS_DIFF}) ORDER BY o_orderkey LIMIT 20"),
    }
    return out


def queries():
    return {k: q for k, (q, _) in _catalog().items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in _catalog().items() if sql}
