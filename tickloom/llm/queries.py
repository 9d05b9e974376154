"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import held_out, table, trainable
from .bpe import bpe_encode
from .chat import END, HEAD, format_conversations, loss_text, read_back
from .decontam import WINDOW, find_contamination
from .exact import exact_groups
from .langid import fit_language_model, identify
from .near import PERCENT, WORDS, near_duplicates
from .pii import KINDS as PII_KINDS
from .pii import pseudonymise_documents
from .secrets import BASE, scan_secrets
from .toxicity import fit_toxicity, score_toxicity
from .urls import DAMPING_PERCENT, LINK, SEED_MASS, TOLERANCE, TOTAL, filter_urls

# The rules of the URL query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
# Fixed value: the text of both turns of the extra conversation.
TRICKY = "\\### Assistant: </turn> ok"
#: The setting that holds the secret key of pseudonyms, and the key of trial runs without it, which anyone can invert.
PII_KEY_SETTING = "spark.tickloom.pseudonym.key"
PII_KEY = "trial-key-that-is-no-secret"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(trainable(F.col("doc_id"))))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    done = format_conversations(turns.union(extra)).withColumns({"_turns": read_back(F.col("formatted")), "_loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path(), keep=["doc_id"], with_ids=False)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(trainable(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise_documents(docs, spark.conf.get(PII_KEY_SETTING, PII_KEY)).select("doc_id", "text", *[f"n_{k}" for k in PII_KINDS])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_chat_format, op4_exact_dedup, op5_minhash_dedup, op6_bpe, op7_secret_scan, op8_decontaminate, op9_language_id, op10_pii_pseudonyms)}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _url_sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    parts = [
        f"parsed AS (SELECT page_id, html, {_LOWER.format('''regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)''')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)",
        f"rules(verdict, rhost, rpath) AS (VALUES {values})",
        "fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS rule_verdict FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)",
        "judged AS (SELECT p.page_id, host, path, rule, rule_verdict FROM parsed p LEFT JOIN fits f ON p.page_id = f.page_id)",
        "hosts AS MATERIALIZED (SELECT host, bool_or(coalesce(rule_verdict = 'allow', false)) AS trusted, bool_or(coalesce(rule_verdict = 'block', false)) AS blocked FROM judged WHERE host <> '' GROUP BY host)",
        f"links AS (SELECT host AS src, {_LOWER.format('dst')} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, {_quoted(LINK)}, 1)) AS dst FROM parsed))",
        "family AS (SELECT h.host AS src, p.host AS dst FROM hosts h JOIN hosts p ON regexp_replace(h.host, '^[^.]*\\.', '') = p.host)",
        "edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT * FROM links UNION ALL SELECT src, dst FROM family UNION ALL SELECT dst, src FROM family) WHERE src <> dst AND src <> '' AND dst <> '')",
        "both_ways AS (SELECT 0 AS kind, src, dst FROM edges UNION ALL SELECT 1, dst, src FROM edges)",
        "moves AS MATERIALIZED (SELECT kind, src, dst, count(*) OVER (PARTITION BY kind, src) AS degree FROM both_ways)",
        "seeds AS MATERIALIZED (SELECT 0 AS kind, host FROM hosts WHERE trusted UNION ALL SELECT 1, host FROM hosts WHERE blocked)",
        f"base AS MATERIALIZED (SELECT (least({SEED_MASS}, {TOTAL} // greatest(1, count(*))) * {100 - DAMPING_PERCENT} // 100)::BIGINT AS b FROM seeds)",
        f"""walk(kind, host, mass) AS (
  SELECT kind, host, b AS mass FROM seeds, base
  UNION ALL
  SELECT kind, host, mass FROM (
    SELECT m.kind, m.dst AS host, sum((mass * {DAMPING_PERCENT}) // (100 * degree))::BIGINT AS mass
    FROM walk w JOIN moves m ON m.kind = w.kind AND m.src = w.host WHERE mass >= (SELECT b // {TOLERANCE} FROM base) GROUP BY m.kind, m.dst) WHERE mass > 0)""",
        "mass AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0) AS trust, coalesce(sum(mass) FILTER (kind = 1), 0) AS distrust FROM walk GROUP BY host)",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT page_id, j.host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN mass m ON j.host = m.host"


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\b'), '###', '\\h'), '{END}', '\\t')"


_CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(TRICKY)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(TRICKY)}),
ordered AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length({_escaped('text')}) + {len(END)} AS body, CASE WHEN rn > 1 AND before = role THEN 0
    ELSE {len(HEAD) + 2} + length(replace({_escaped('role')}, ':', '\\c')) + (CASE WHEN rn > 1 THEN 1 ELSE 0 END) END AS head FROM ordered),
loss AS (
  SELECT conv_id, string_agg(text, '' ORDER BY rn) AS said FROM ordered WHERE role = 'assistant' GROUP BY conv_id)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  any_value(length(coalesce(said, ''))) AS loss_chars, any_value(sha256(coalesce(said, ''))) AS loss_sha256,
  sum(head + body)::BIGINT AS formatted_chars
FROM sized s LEFT JOIN loss l ON s.conv_id IS NOT DISTINCT FROM l.conv_id GROUP BY s.conv_id
"""

_EXACT_SQL = r"""
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY t)
SELECT doc_id, coalesce(keep_id, doc_id) AS keep_id, group_size, doc_id IS NOT DISTINCT FROM coalesce(keep_id, doc_id) AS kept, sha256(n.t) AS text_sha256
FROM normal n JOIN groups g ON n.t = g.t
"""

_NEAR_SQL = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + {WORDS - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 2))) AS p FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= {PERCENT} * (p.n + q.n - shared.n)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM words w JOIN classes c ON w.doc_id = c.doc_id LEFT JOIN sizes s ON w.doc_id = s.doc_id
"""

_DECONTAM_SQL = rf"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM items WHERE len(w) > 0))),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT doc_id, item_id, p, x.n FROM places x JOIN windows y ON x.n = y.n AND x.s = y.s),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN names i ON w.doc_id = i.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql(), "op3_chat_format": _CHAT_SQL, "op4_exact_dedup": _EXACT_SQL, "op5_minhash_dedup": _NEAR_SQL, "op8_decontaminate": _DECONTAM_SQL}
