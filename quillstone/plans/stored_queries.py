"""Queries through stored tables, the tail of files that Spark writes from the given tables, and edits of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import sources, streaming
from quillstone.operators import fixes
from quillstone.operators.entry_store import EntryStore
from quillstone.operators.search_index import SearchIndex
from quillstone.operators.store import shared_folder
from quillstone.plans import registry as r
from quillstone.plans.registry import query


def new_root(t, name: str) -> str:
    return f"{shared_folder(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query(r"""WITH f AS (SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'License version' || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS x FROM documents WHERE lang IS DISTINCT FROM 'es'),
l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS content, generate_subscripts(string_split(x, chr(10)), 1) AS line FROM f),
c AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM l WHERE trim(content) <> ''),
k AS (SELECT doc_id, line, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'version')) AS b FROM c),
s AS (SELECT count(*) AS N, sum(n) / count(*) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM k)
SELECT doc_id::VARCHAR AS path, line, round(0.0 + ln((s.N - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * k.n / av)) + ln((s.N - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * k.n / av)), 6) AS rank FROM k, s WHERE a > 0 AND b > 0""")
def stored_bm25(t):
    """Documents as files, indexed; those of one language change, those of another go."""
    index = SearchIndex(t("documents").sparkSession, new_root(t, "index"))
    files = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.lit(1).cast("long").alias("mtime"), "lang")
    index.refresh(files.drop("lang"))
    changed = files.where("lang = 'de'").select("path", F.concat(F.lit("License version\n"), "content").alias("content"), F.lit(2).cast("long").alias("mtime"))
    index.refresh(changed, gone=files.where("lang = 'es'").select("path"))
    return index.bm25("License: (version)", None)


@query("""WITH e AS (SELECT conv_id::VARCHAR AS id, sha256(coalesce(text, '')) AS hash, role, turn FROM conversations),
a1 AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC, id, hash) = 1), a AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY hash ORDER BY turn DESC, id, hash) = 1),
b1 AS (SELECT * FROM e WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC, id, hash) = 1), b AS (SELECT * FROM b1 WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY turn DESC, id, hash) = 1),
u AS (SELECT * FROM b UNION ALL SELECT * FROM a WHERE id NOT IN (SELECT id FROM b) AND hash NOT IN (SELECT hash FROM b))
SELECT id, hash, role FROM u WHERE id NOT IN (SELECT conv_id::VARCHAR FROM conversations WHERE role = 'system')""")
def store_upsert(t):
    """The latest message of each conversation, then the latest of its user, put into a store; conversations with a system turn are deleted."""
    s = EntryStore(t("conversations").sparkSession, new_root(t, "entries"))
    e = t("conversations").select(F.col("conv_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "role", "turn")
    s.put(e, "turn")
    s.put(e.where("role = 'user'"), "turn")
    s.delete(e.where("role = 'system'"))
    return s.table()


@query(f"""WITH m AS (SELECT conv_id, role, coalesce(text, '') AS x FROM conversations WHERE trim(coalesce(text, '')) <> '')
SELECT conv_id::VARCHAR AS session, CASE WHEN role IN ('user', 'assistant') THEN 'conversation' ELSE 'other' END AS kind, count(*) AS messages, sum({r.EST.format("x")})::BIGINT AS tokens FROM m GROUP BY ALL""")
def tail_messages(t):
    """Conversations written as JSON lines and read back by the tail of their folder."""
    root = new_root(t, "transcripts")
    t("conversations").select(F.col("conv_id").cast("string").alias("of"), "role", F.col("text").alias("content")).write.json(root)
    lines = sources.tail(t("conversations").sparkSession, root, "*.json").withColumn("of", F.get_json_object("value", "$.of"))
    m = streaming.drain(sources.jsonl_messages(lines, "value", "of"), "append")
    return m.groupBy(F.col("of").alias("session"), "kind").agg(F.count("*").alias("messages"), F.sum(Q.token_estimate(F.col("content"))).alias("tokens"))


#: Fixes of texts: tokens are blanked, a licence's name is spelt another way.
TEXT_FIXES = [
    fixes.Fix("DOC-TOKEN", r"token = \"[0-9a-f]+\"", 'token = ""', "{} token(s)"),
    fixes.Fix("DOC-LICENSE", r"(Apache|MIT) License", "$1 Licence", "{} name(s)"),
]


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
n AS (SELECT doc_id, x, len(regexp_extract_all(x, 'token = "[0-9a-f]+"')) AS a, len(regexp_extract_all(x, '(Apache|MIT) License')) AS b FROM d)
SELECT doc_id::VARCHAR AS path, sha256(regexp_replace(regexp_replace(x, 'token = "[0-9a-f]+"', 'token = ""', 'g'), '(Apache|MIT) License', '\1 Licence', 'g')) AS hash, (a + b)::INT AS applied FROM n WHERE a + b > 0""")
def document_fixes(t):
    files = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    out = fixes.apply_actions(files, fixes.fix_actions(files, fixes=TEXT_FIXES), TEXT_FIXES)
    return out.select("path", F.sha2("content", 256).alias("hash"), "applied")
