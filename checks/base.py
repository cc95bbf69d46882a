"""Registered queries on sources, rows and profiles, each with its SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.staging import new_folder
from tablewright.operators import profile, rows
from tablewright.operators.repair import trim_collapse
from tablewright.sources import catalog, files

from .tables import DIRTY_COLUMNS, dirty, table, with_dirty

FOLDER = r"/([^/]+)/[^/]+$"
DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
DELIMITER_SQL = "(VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('pipe', '|')) f(folder, delimiter)"


def us(name: str):
    """A timestamp as microseconds, so that both engines print it alike."""
    return F.unix_micros(F.col(name).cast("timestamp"))


def joined(name: str, sep: str = "|"):
    return F.array_join(name, sep)


def scan_csv(s, d):
    path = new_folder(s, "csv")
    events = table(s, d, "events").withColumn("ts", F.col("ts").cast("string"))
    files.sink_clean_table(events, path, "csv")
    return files.scan_csv(s, path)


def _delimited(s, d):
    root = new_folder(s, "delimited")
    events = table(s, d, "events").select("event_id", "user_id", "event_type")
    for name, sep in DELIMITERS.items():
        files.sink_clean_table(events, f"{root}/{name}", "csv", options={"sep": sep})
    empty_file(s, f"{root}/empty/nothing.csv")
    return root


def empty_file(s, name: str) -> None:
    path = s._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(s._jsc.hadoopConfiguration()).create(path).close()


def infer_delimiter(s, d):
    root = _delimited(s, d)
    found = files.infer_delimiter(s, root).select(F.regexp_extract("file", FOLDER, 1).alias("folder"), "delimiter")
    out = None
    for name, sep in DELIMITERS.items():
        back = files.scan_csv(s, f"{root}/{name}", sep, "event_id bigint, user_id bigint, event_type string", multiline=False)
        part = back.where("user_id IS NOT NULL AND event_type IS NOT NULL").agg(F.count("event_id").alias("rows"))
        part = part.select(F.lit(name).alias("folder"), "rows")
        out = part if out is None else out.unionByName(part)
    return found.distinct().join(out, "folder", "left")


def conform_schema(s, d):
    root = new_folder(s, "headers")
    events = table(s, d, "events").drop("props", "ts")
    files.sink_clean_table(events, f"{root}/same", "csv")
    files.sink_clean_table(events.drop("value"), f"{root}/short", "csv")
    files.sink_clean_table(events.withColumnRenamed("user_id", "client"), f"{root}/renamed", "csv")
    empty_file(s, f"{root}/empty/nothing.csv")
    report = files.conform_schema(s, root, events.columns)
    return report.select(F.regexp_extract("file", FOLDER, 1).alias("folder"), "column", "status").distinct()


def sink_clean_table(s, d):
    path = files.sink_clean_table(trim_collapse(dirty(s, d), ["product"]), new_folder(s, "clean"))
    return s.read.parquet(path).select("event_id", us("sale_date").alias("sale_us"), "product", "quantity", "amount")


def _catalog(s, d):
    root = _delimited(s, d)
    entries = catalog.describe_files(s, root, files.infer_delimiter(s, root))
    where = new_folder(s, "catalog")
    catalog.register(entries, where)
    catalog.register(entries, where)  # once more: still one row a dataset
    return catalog.load_catalog(s, where)


def catalog_health(s, d):
    """Number of datasets and the latest one, and whether they are those of the catalog itself."""
    known = _catalog(s, d)
    health = catalog.catalog_health(known)
    folders = known.where("file_size_bytes > 0").agg(
        F.countDistinct(F.regexp_extract("stored_file", FOLDER, 1)).alias("folders"), F.max("uploaded_at").alias("newest")
    )
    empty = known.where("file_size_bytes = 0").agg(F.count(F.lit(1)).alias("empty"), F.max("uploaded_at").alias("last"))
    both = health.crossJoin(folders).crossJoin(empty)  # one row each
    newest = F.greatest("newest", "last") == F.col("latest_dataset")
    return both.select("status", "folders", "empty", (F.col("datasets") >= F.col("folders") + F.col("empty")).alias("all_listed"), newest.alias("newest"))


def dataset_catalog(s, d):
    known = _catalog(s, d)
    folder = F.regexp_extract("stored_file", FOLDER, 1).alias("folder")
    return known.select(
        folder, "extension", "file_type", "raw_filename", "delimiter", (F.col("file_size_bytes") > 0).alias("sized")
    ).distinct()


def token_budget_sample(s, d):
    sample, _ = rows.token_budget_sample(table(s, d, "conversations"), ["conv_id", "turn"], 500, 20_000)
    return sample


WIDE = [f"column_{i:02}" for i in range(1, 12)]
WIDE_LIMIT = 2_000


def fit_to_budget_wide(s, d):
    """Twelve columns and a small budget: the floor of rows is reached, then columns are dropped from the right."""
    events = table(s, d, "events")
    wide = events.select("event_id", *[F.repeat("event_type", F.lit(i)).alias(c) for i, c in enumerate(WIDE, 1)])
    fitted = rows.fit_to_budget(wide, ["event_id"], 1_000, WIDE_LIMIT)
    facts = (F.lit(fitted.rows).cast("bigint").alias("rows"), F.lit(float(fitted.tokens)).alias("tokens"), F.lit("|".join(fitted.dropped_columns)).alias("dropped"))
    return fitted.sample.select("event_id", F.concat_ws("|", *fitted.sample.columns[1:]).alias("cells"), *facts)


def _wide_sql() -> str:
    names = ["event_id", *WIDE]
    widths = "".join(
        f"{' UNION ALL ' if w < 12 else ''}SELECT {w} AS w, ({rows.csv_header_length(names[:w])} + sum(length(CAST(event_id AS VARCHAR)) "
        f"+ {sum(range(w))} * length(event_type)) + 25 * {w}) / 2.0 AS tokens, '{'|'.join(reversed(names[w:]))}' AS dropped FROM head"
        for w in range(12, 4, -1)
    )
    return (
        f"WITH head AS (SELECT * FROM events ORDER BY event_id LIMIT 25), sizes AS ({widths}), "
        f"chosen AS (SELECT * FROM sizes WHERE tokens <= {WIDE_LIMIT} OR w = 5 ORDER BY w DESC LIMIT 1) "
        "SELECT event_id, array_to_string(list_transform(range(1, w), lambda i: repeat(event_type, i)), '|') AS cells, "
        "CAST(25 AS BIGINT) AS rows, CAST(tokens AS DOUBLE) AS tokens, dropped FROM head, chosen"
    )


def fit_to_budget(s, d):
    fitted = rows.fit_to_budget(table(s, d, "conversations"), ["conv_id", "turn"], 500, 20_000)
    return fitted.sample


CSV_LEN = " + ".join(
    f"(length({t}) + CASE WHEN regexp_matches({t}, '[\",\\r\\n]') "
    f"THEN length({t}) - length(replace({t}, '\"', '')) + 2 ELSE 0 END)"
    for t in [f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("conv_id", "turn", "role", "text")]
)
CONV_HEADER = len("conv_id") + len("turn") + len("role") + len("text") + 4

PROFILE_TYPES = {
    "event_id": ("numeric", "bigint"),
    "user_id": ("numeric", "bigint"),
    "event_type": (None, "string"),
    "product": (None, "string"),
    "order_list": (None, "string"),
    "dept_fullname": (None, "string"),
    "sale_date": ("date", "timestamp_ntz"),
    "quantity": ("numeric", "int"),
    "amount": ("numeric", "double"),
    "amount_text": (None, "string"),
    "date_text": (None, "string"),
}


def _stats_cte() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing_count, "
        f"count(DISTINCT {c}) AS unique_count, '{t or ''}' AS fixed, '{p}' AS physical_type FROM dirty"
        for c, (t, p) in PROFILE_TYPES.items()
    ]
    typed = (
        "CASE WHEN fixed <> '' THEN fixed WHEN unique_count / greatest(n, 1) <= 0.2 THEN 'categorical' "
        "ELSE 'string' END AS data_type"
    )
    return "stats0 AS (" + " UNION ALL ".join(parts) + f"),\nstats AS (SELECT *, {typed} FROM stats0)"


def _samples_cte() -> str:
    parts = []
    for c in DIRTY_COLUMNS:
        parts.append(
            f"SELECT '{c}' AS \"column\", (SELECT string_agg(v, '|' ORDER BY event_id, v) FROM (SELECT event_id, "
            f"CAST({c} AS VARCHAR) AS v FROM dirty WHERE {c} IS NOT NULL ORDER BY event_id, v LIMIT 3)) AS samples"
        )
    return "samples AS (" + " UNION ALL ".join(parts) + ")"


OBSERVATIONS = """obs AS (SELECT row_number() OVER (ORDER BY missing_count DESC, "column") - 1 AS position,
  "column" || ' contient ' || missing_count || ' valeurs manquantes' AS observation
  FROM stats WHERE missing_count > 0 ORDER BY missing_count DESC, "column" LIMIT 3)"""

NUMERIC = ("event_id", "user_id", "quantity", "amount")
TEXTS = [c for c, (t, _) in PROFILE_TYPES.items() if t is None]

QUERIES = {
    "scan_csv": scan_csv,
    "infer_delimiter": infer_delimiter,
    "conform_schema": conform_schema,
    "sink_clean_table": sink_clean_table,
    "dataset_catalog": dataset_catalog,
    "catalog_health": catalog_health,
    "project_columns": lambda s, d: rows.project_columns(table(s, d, "lineitem"), ["l_orderkey", "l_quantity"]),
    "filter_predicate": lambda s, d: rows.filter_predicate(
        table(s, d, "lineitem"), F.col("l_quantity") > 49, F.col("l_discount") > 0.09
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
    "head_sample": lambda s, d: rows.head_sample(table(s, d, "customer"), ["c_custkey"], 10),
    "stratified_position_sample": lambda s, d: rows.stratified_position_sample(table(s, d, "orders"), "o_orderkey").select(
        "o_orderkey", "o_custkey", "o_orderstatus"
    ),
    "token_budget_sample": token_budget_sample,
    "fit_to_budget": fit_to_budget,
    "fit_to_budget_wide": fit_to_budget_wide,
    "truncate_text": lambda s, d: rows.truncate_text(table(s, d, "documents")),
    "random_sample": lambda s, d: rows.random_sample(table(s, d, "orders"), ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice"
    ),
    "row_column_count": lambda s, d: profile.row_column_count(dirty(s, d)),
    "column_types": lambda s, d: profile.column_types(dirty(s, d)),
    "null_rates": lambda s, d: profile.null_rates(dirty(s, d)).withColumn(
        "missing_percent", F.round("missing_percent", 6)
    ),
    "null_counts": lambda s, d: profile.null_counts(dirty(s, d)),
    "distinct_counts": lambda s, d: profile.distinct_counts(dirty(s, d)),
    "sample_values": lambda s, d: profile.sample_values(dirty(s, d), ["event_id"]).select(
        "column", joined("sample_values").alias("samples")
    ),
    "column_profile": lambda s, d: profile.column_profile(dirty(s, d), ["event_id"]).withColumn(
        "sample_values", joined("sample_values")
    ),
    "top_missing_observations": lambda s, d: profile.top_missing_observations(dirty(s, d)),
    "numeric_summary": lambda s, d: profile.numeric_summary(dirty(s, d)).withColumn("mean", F.round("mean", 6)),
    "categorical_summary": lambda s, d: profile.categorical_summary(dirty(s, d)),
    "value_counts": lambda s, d: profile.value_counts(dirty(s, d), "product"),
    "dataset_summary": lambda s, d: profile.dataset_summary(
        dirty(s, d), "events", "Dataset importé via PARQUET"
    ).withColumn("observations", joined("observations")),
}

STATS, SAMPLES = _stats_cte(), _samples_cte()

ORACLE = {
    "scan_csv": "SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props FROM events",
    "infer_delimiter": f"SELECT folder, delimiter, (SELECT count(*) FROM events) AS rows FROM {DELIMITER_SQL} "
    "UNION ALL SELECT 'empty', ',', NULL",
    "conform_schema": "WITH c AS (SELECT column_name AS c FROM (DESCRIBE SELECT * EXCLUDE (props, ts) FROM events)) "
    "SELECT 'short' AS folder, c AS \"column\", 'missing' AS status FROM c WHERE c = 'value' "
    "UNION ALL SELECT 'renamed', c, 'missing' FROM c WHERE c = 'user_id' UNION ALL SELECT 'renamed', 'client', 'extra' "
    "UNION ALL SELECT 'empty', c, 'missing' FROM c",
    "sink_clean_table": with_dirty(
        "SELECT event_id, epoch_us(sale_date) AS sale_us, trim(regexp_replace(product, '\\s+', ' ', 'g')) AS product, "
        "quantity, amount FROM dirty"
    ),
    "dataset_catalog": "SELECT folder, '.csv' AS extension, 'csv' AS file_type, 'raw.csv' AS raw_filename, delimiter, "
    f"true AS sized FROM {DELIMITER_SQL} UNION ALL SELECT 'empty', '.csv', 'csv', 'raw.csv', ',', false",
    "catalog_health": f"SELECT 'up' AS status, count(*) AS folders, CAST(1 AS BIGINT) AS empty, true AS all_listed, true AS newest FROM {DELIMITER_SQL}",
    "fit_to_budget_wide": _wide_sql(),
    "project_columns": "SELECT l_orderkey, l_quantity FROM lineitem",
    "filter_predicate": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem "
    "WHERE l_quantity > 49 OR l_discount > 0.09::DOUBLE",
    "head_sample": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
    "stratified_position_sample": """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn,
      count(*) OVER () AS total FROM orders),
    m AS (SELECT * FROM n WHERE total > 300 AND rn > 100 AND rn <= total - 100
      ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 100)
    SELECT o_orderkey, o_custkey, o_orderstatus FROM n WHERE total <= 300 OR rn <= 100 OR rn > total - 100
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM m""",
    "token_budget_sample": f"""WITH probe AS (SELECT {CSV_LEN} + 4 AS chars
      FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 50)),
    est AS (SELECT (sum(chars) + {CONV_HEADER}) / count(*) * 500 / 2.0 AS tokens FROM probe),
    lim AS (SELECT CASE WHEN tokens <= 20000 THEN 500
      ELSE greatest(10, CAST(floor(500 * (20000 / tokens) * 0.8) AS BIGINT)) END AS k FROM est)
    SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn
      FROM conversations), lim WHERE rn <= k""",
    "fit_to_budget": f"""WITH RECURSIVE sample AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn
      FROM conversations) WHERE rn <= 500),
    pre AS (SELECT rn, ({CONV_HEADER} + sum({CSV_LEN} + 4) OVER (ORDER BY rn)) / 2.0 AS tokens FROM sample),
    step AS (SELECT rn, tokens FROM pre WHERE rn = (SELECT max(rn) FROM pre)
      UNION ALL SELECT p.rn, p.tokens FROM step s JOIN pre p ON p.rn = CASE
        WHEN greatest(25, CAST(floor(s.rn * (20000 / greatest(s.tokens, 1)) * 0.85) AS BIGINT)) < s.rn
        THEN greatest(25, CAST(floor(s.rn * (20000 / greatest(s.tokens, 1)) * 0.85) AS BIGINT))
        ELSE greatest(25, s.rn - 5) END WHERE s.tokens > 20000 AND s.rn > 25)
    SELECT conv_id, turn, role, text FROM sample WHERE rn <= (SELECT min(rn) FROM step)""",
    "truncate_text": "SELECT doc_id, substring(text, 1, 50) AS text, substring(lang, 1, 50) AS lang, "
    "substring(source, 1, 50) AS source, n_chars FROM documents",
    "random_sample": "SELECT o_orderkey, o_totalprice FROM orders "
    "ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 10000",
    "row_column_count": with_dirty("SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM dirty"),
    "column_types": with_dirty('SELECT "column", data_type, physical_type FROM stats', STATS),
    "null_rates": with_dirty(
        'SELECT "column", missing_count, round(missing_count * 100.0::DOUBLE / n, 6) AS missing_percent '
        "FROM stats WHERE missing_count > 0",
        STATS,
    ),
    "null_counts": with_dirty('SELECT "column", missing_count FROM stats', STATS),
    "distinct_counts": with_dirty('SELECT "column", unique_count FROM stats', STATS),
    "sample_values": with_dirty('SELECT "column", samples FROM samples', SAMPLES),
    "column_profile": with_dirty(
        'SELECT s."column", data_type, physical_type, n AS rows, missing_count, unique_count, '
        "samples AS sample_values, 'Detected as ' || data_type || '. ' || unique_count || ' unique values with ' || "
        "missing_count || ' missing entries out of ' || n || '.' AS description "
        'FROM stats s JOIN samples v ON s."column" = v."column"',
        STATS,
        SAMPLES,
    ),
    "top_missing_observations": with_dirty(
        "SELECT CAST(position AS INTEGER) AS position, observation FROM obs", STATS, OBSERVATIONS
    ),
    "numeric_summary": with_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
            f"round(avg({c}), 6) AS mean FROM dirty"
            for c in NUMERIC
        )
    ),
    "categorical_summary": with_dirty(
        'SELECT "column", unique_count AS categories FROM stats WHERE physical_type = \'string\'', STATS
    ),
    "value_counts": with_dirty(
        "SELECT product AS value, count(*) AS rows FROM dirty WHERE product IS NOT NULL GROUP BY 1"
    ),
    "dataset_summary": with_dirty(
        "SELECT 'events' AS name, 'Dataset importé via PARQUET' AS description, (SELECT count(*) FROM dirty) AS row_count, "
        "CAST(11 AS BIGINT) AS column_count, (SELECT string_agg(observation, '|' ORDER BY position) FROM obs) AS observations",
        STATS,
        OBSERVATIONS,
    ),
}
