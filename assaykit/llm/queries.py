"""Queries of the operators in this subpackage, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """A small table of fewer partitions than cores (one file of one row group) over all cores, for operators that work hard on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import ngram_jaccard

    return ngram_jaccard(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 counts, without the verdict that SQL can't express."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_format

    return chat_format(_table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "benchmark")).drop("item_ids")


#: Where the public tokenizers lie; a parameter, never copied into the repository.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def _maintained(spark: SparkSession, sf_dir: str, tokenizers: dict) -> DataFrame:
    """Loads all documents, deletes one source, revises another, compacts; every batch comes twice."""
    from .scratch import Scratch
    from .token_counts import TokenRollup

    rollup = TokenRollup(spark, Scratch(spark).dir, tokenizers)
    docs = _spread(_table(spark, sf_dir, "documents").select("source", "lang", "text"))
    old = docs.where("source = 'src2'")
    revised = old.withColumns({"sign": F.lit(1), "text": F.concat("text", F.lit(" revised"))})
    batches = {
        "load": docs.withColumn("sign", F.lit(1)),
        "delete src1": docs.where("source = 'src1'").withColumn("sign", F.lit(-1)),
        "revise src2": old.withColumn("sign", F.lit(-1)).unionByName(revised),
    }
    for name, changes in batches.items():
        rollup.commit(name, changes)
        rollup.commit(name, changes)  # a batch that comes again counts once
    rollup.compact()
    return rollup.totals()


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import byte_bpe_tokenizer, words_tokenizer

    return _maintained(spark, sf_dir, {"words@1": words_tokenizer(), "byte_bpe_50k@1": byte_bpe_tokenizer(TOKENIZERS, "byte_bpe_50k.tiktoken")})


def token_counts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup with the tokenizer that SQL can express."""
    from .token_counts import words_tokenizer

    return _maintained(spark, sf_dir, {"words@1": words_tokenizer()})


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_unigram import sentencepiece

    docs = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentencepiece(docs, f"{TOKENIZERS}/piece_bpe_32k.model", outputs=("n_tokens", "n_byte_tokens", "ids_sha256", "round_trip")).drop("text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs, labels = _spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, labels.where(~held))
    return toxicity(docs, model, spans=False).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scoring, mark_target

    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return lm_scoring(mark_target(docs, labels.where("quality = 1")))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import html_extract

    return html_extract(_spread(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import lexical_search

    return lexical_search(_spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_counts, op2_suffix_dedup, op3_chat_format, op4_ngram_jaccard, op5_warc, op6_sentencepiece, op7_quality_rules, op8_toxicity, op9_decontaminate,
        op10_lm_scoring, op11_html_extract, op12_lexical_search, token_counts_words, quality_counts,
    )}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows are cut out of pieces of 512 bytes and what is kept out of the gaps between spans, as substr() walks from the start of its text.
SQL_OP2 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS MATERIALIZED (SELECT doc_id, len(h) // 2 AS n, 512 * j AS o, substr(h, 1024 * j + 1, 1122) AS piece FROM d, unnest(range(0, len(h) // 1024 + 1)) AS t(j)),
w AS MATERIALIZED (SELECT doc_id, o + i AS i, substr(piece, 2 * i + 1, 100) AS g FROM p, unnest(range(0, greatest(least(n - 49 - o, 512), 0))) AS t(i)),
m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING count(*) > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM w JOIN m USING (g) WHERE low < doc_id),
r AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
s AS (SELECT doc_id, k, min(i) AS b, max(i) + 50 AS e FROM r GROUP BY doc_id, k),
n AS (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS b, b AS e FROM s UNION ALL SELECT doc_id, max(e), NULL FROM s GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * b + 1, coalesce(2 * (e - b), len(h))), '' ORDER BY b) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL_OP3 = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY k) AS l,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
  FROM t GROUP BY conv_id),
proper AS (SELECT DISTINCT list_slice(l, 1, j) AS l FROM c, unnest(range(1, len(l))) AS u(j)),
uniq AS (SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l)
SELECT u.conv_id, CAST(len(u.l) AS BIGINT) AS n_turns, u.n_copies, c.rendered
FROM uniq u JOIN c USING (conv_id) ANTI JOIN proper p ON u.l = p.l
"""

SQL_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 5) - 1) AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
c AS MATERIALIZED (SELECT doc_id, g FROM s SEMI JOIN common USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""

SQL_OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS INT) >> k) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS digest,
        min(page_id) OVER (PARTITION BY n, x) AS low FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> low THEN low END AS refers_to FROM b
"""

SQL_TOKENS = """
WITH t AS (SELECT source, lang, len(regexp_extract_all(coalesce(CASE WHEN source = 'src2' THEN text || ' revised' ELSE text END, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents WHERE source <> 'src1' OR source IS NULL)
SELECT source, lang, 'words@1' AS tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM t GROUP BY source, lang
"""

SQL_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM r, unnest(range(i, i + 5)) AS u(p) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols FROM d)
SELECT m.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
FROM m LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL_OP9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, list_slice(w, s, s + least(len(w), 10) - 1) AS g FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(g) AS l FROM win),
dw AS (SELECT doc_id, s, l, list_slice(w, s, s + l - 1) AS g FROM d, lens, unnest(range(1, greatest(len(w) - l + 1, 0) + 1)) AS t(s)),
hits AS (SELECT doc_id, s, l, item FROM dw JOIN win USING (g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, l FROM hits), unnest(range(s, s + l)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: The pages of these tables mark their article, so its text can be cut out by position.
SQL_OP11 = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
t AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(regexp_replace(h, '</?(h1|p)>|<br>', ' ', 'g'), '<b>', ''), '&quot;', '"', 'g'), '\\s+', ' ', 'g')) AS h FROM a),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39), 'g'), '&amp;?', '&', 'g')) AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

SQL_OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
v AS (SELECT DISTINCT term FROM qt),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) SEMI JOIN v USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
m AS (SELECT doc_id, 25 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS part FROM tf JOIN m USING (doc_id) JOIN w USING (term)),
r AS (SELECT item_id, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM qt JOIN i USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r QUALIFY rank <= 10
"""

def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": SQL_OP2, "op3_chat_format": SQL_OP3, "op4_ngram_jaccard": SQL_OP4, "op5_warc": SQL_OP5, "token_counts_words": SQL_TOKENS, "quality_counts": SQL_QUALITY, "op9_decontaminate": SQL_OP9, "op11_html_extract": SQL_OP11, "op12_lexical_search": SQL_OP12}
