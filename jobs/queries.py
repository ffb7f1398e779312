"""The jobs as queries: each runs twice into a new folder of its own; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from assaykit.sources.shared import new_folder

from .config import read_config
from .intake import IntakeConfig, intake
from .shortlist import ShortlistConfig, shortlist

HERE = Path(__file__).parent
SHORTLIST, INTAKE = read_config(ShortlistConfig, HERE / "shortlist.json"), read_config(IntakeConfig, HERE / "intake.json")
SHORTLIST_SCHEMA = "doc_id bigint, source string, n_words int, symbol_share double, alerts string, duplicate_of bigint, score double, rank int, lang string, status string"
REGISTER_SCHEMA = "identifier bigint, ord bigint, source string, lang string, n_words int, key string, duplicate_of bigint, epoch bigint, status string"


def job1_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job1-shortlist")
    for _ in range(2):
        shortlist(spark, f"{sf_dir}/documents.parquet", out, SHORTLIST)
    return spark.read.schema(SHORTLIST_SCHEMA).parquet(out).drop("symbol_share")


def job2_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "job2-intake")
    for _ in range(2):
        # a table may be one file, which a stream takes by a pattern only
        intake(spark, f"{sf_dir}/documents.parquet*", f"{out}/register", f"{out}/checkpoint", INTAKE)
    rows = spark.read.schema(REGISTER_SCHEMA).parquet(f"{out}/register")
    return rows.selectExpr("identifier AS doc_id", "source", "lang", "n_words", "key", "duplicate_of", "status")


_SPACE = r"[ \t\n\x0B\f\r]+"
_D = rf"""d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS INT) AS n_words,
  (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', ''))) / greatest(length(coalesce(text, '')), 1) AS symbol_share,
  sha256(trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}', ' ', 'g'))) AS k FROM documents)"""


def _shortlist_sql(c: ShortlistConfig) -> str:
    hit = {name: f"coalesce(regexp_matches(text, '{p}'), false)" for name, p in c.alerts.items()}
    alerts = f"list_filter([{', '.join(f'''CASE WHEN {h} THEN '{name}' END''' for name, h in hit.items())}], lambda x: x IS NOT NULL)"
    outside = " OR ".join([f"{k} < {low}" for k, (low, _) in c.windows.items() if low is not None] + [f"{k} > {high}" for k, (_, high) in c.windows.items() if high is not None])
    dropping = " OR ".join(hit[a] for a in c.drop_alerts)
    return f"""WITH {_D},
a AS (SELECT *, {alerts} AS found, CASE WHEN {outside} THEN 'dropped_by_window' WHEN {dropping} THEN 'dropped_by_alert' END AS drop_reason FROM d),
f AS (SELECT *, CASE WHEN drop_reason IS NULL THEN min(doc_id) OVER (PARTITION BY drop_reason IS NULL, k) END AS first FROM a),
s AS (SELECT *, CASE WHEN first < doc_id THEN first END AS duplicate_of,
  CASE WHEN drop_reason IS NULL AND NOT coalesce(first < doc_id, false)
   THEN round(exp(-pow((ln(greatest(n_words, 1)) - ln({float(c.centre_words)})) / {c.width}, 2) / 2) / (1 + len(found)) / (1 + 10 * symbol_share), 9) END AS score FROM f),
r AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY lang, score IS NULL ORDER BY score DESC, doc_id) END AS place FROM s)
SELECT doc_id, source, n_words, array_to_string(found, ',') AS alerts, duplicate_of, score, CAST(CASE WHEN place <= {c.top_n} THEN place END AS INT) AS rank, lang,
  coalesce(drop_reason, CASE WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN place <= {c.top_n} THEN 'shortlisted' ELSE 'below_cut' END) AS status FROM r"""


_INTAKE_SQL = f"""WITH {_D}, e AS (SELECT doc_id, source, lang, n_words, CASE WHEN n_words > 0 THEN k END AS key FROM d),
f AS (SELECT *, CASE WHEN key IS NOT NULL THEN min(doc_id) OVER (PARTITION BY key) END AS first FROM e)
SELECT doc_id, source, lang, n_words, key, CASE WHEN first < doc_id THEN first END AS duplicate_of,
  CASE WHEN key IS NULL THEN 'empty' WHEN first < doc_id THEN 'duplicate' ELSE 'new' END AS status FROM f"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_shortlist": job1_shortlist, "job2_intake": job2_intake}


def oracle_sql() -> dict[str, str]:
    return {"job1_shortlist": _shortlist_sql(SHORTLIST), "job2_intake": _INTAKE_SQL}
