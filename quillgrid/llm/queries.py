"""The text operators as queries over their whole tables, and their DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, centroids, chat, html_main, merkle, quality_rulefit, sharding, suffix_dedup
from quillgrid.llm import decontaminate as dc
from quillgrid.llm import quality_rules as qr
from quillgrid.llm import simhash as sh
from quillgrid.llm import token_files as tf
from quillgrid.llm import toxicity
from quillgrid.llm.common import ascii_lower
from quillgrid.session import checkpoint_root
from quillgrid.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qr.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def _js(shares: list[str], reference: list[float]) -> str:
    parts = []
    for p, q in zip(shares, reference, strict=True):
        parts.append(f"CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q!r}) / 2)) ELSE 0 END")
        if q > 0:
            parts.append(f"{q!r} * log2({q!r} / (({p} + {q!r}) / 2))")
    return f"sqrt(greatest(({' + '.join(parts)}) / 2, 0))"


def _op10_sql(rules: qr.Rules = qr.Rules()) -> str:
    blanks, ws = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
    words = sorted({w for x in qr.WORD_SHARES.values() for w in x})
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '[{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS c_{k}" for k, c in qr.CLASSES.items())
    counts = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(repr(x) for x in qr.forms(w))}))) AS w_{w}" for w in words)
    seen = [f"c_{k}" for k in (*qr.CLASSES, "blank", "wide")]
    shares = [f"(({c})::DOUBLE / greatest(n, 1))" for c in (*seen, f"(n - ({' + '.join(seen)}))")]
    by_class = ", ".join(_js(shares, list(q)) for q in qr.CLASS_SHARES.values())
    by_word = []
    for q in qr.WORD_SHARES.values():
        p = [f"(w_{w}::DOUBLE / greatest(n_words, 1))" for w in q]
        by_word.append(_js([*p, f"greatest(1 - ({' + '.join(p)}), 0)"], [*q.values(), 1 - sum(q.values())]))
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{ws}') AS ws, length(t) AS n FROM d),
    grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
              FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
    repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat
                 FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams), unnest([0, 1, 2]) AS v(k)
                 WHERE c > 1 GROUP BY r),
    f AS (SELECT doc_id, n, len(ws) AS n_words, length(regexp_replace(t, '{blanks}', '', 'g')) AS word_chars,
            len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}'))) AS n_lines,
            len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}')))) AS n_lines1,
            coalesce(n_repeat, 0) AS n_repeat_words, n - length(regexp_replace(t, '{blanks}', '', 'g')) AS c_blank,
            n - length(regexp_replace(t, '[^\x00-\x7F]+', '', 'g')) AS c_wide, {classes}, {counts}
          FROM w LEFT JOIN repeated USING (r)),
    j AS (SELECT *, least({by_class}) AS jc, least({', '.join(by_word)}) AS jw,
            n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM f)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols,
      (n_lines - n_lines1)::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
      NOT base_failed AND ((n < {rules.class_guard_chars} OR jc <= {rules.class_distance})
        AND (n_words < {rules.word_guard_words} OR jw <= {rules.word_distance}) OR c_wide > {rules.other_script} * n) AS kept
    FROM j"""


ORACLES["op10_quality_rules"] = _op10_sql()


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP6_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op6_decontaminate"] = f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_OP6_WORDS} AS ws FROM documents),
    b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_OP6_WORDS} AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w
           FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS u(i) WHERE len(ws) > 0),
    dw AS (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w
           FROM (SELECT d.*, l.n FROM d, (SELECT DISTINCT n FROM iw) l), unnest(range(1, len(ws) - n + 2)) AS u(i)),
    hit AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
    n_hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit), unnest(range(n)) AS v(k) GROUP BY r),
    n_items AS (SELECT r, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id)), ',')) AS items_sha256 FROM hit GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.near_duplicates(table(spark, sf_dir, "documents"))


#: The public tokenizer that the token queries use: its name, or a path that every executor can read.
TOKENIZER = os.environ.get("QUILLGRID_TOKENIZER", "byte_bpe_50k.json")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_root(spark)}/token-files-{uuid.uuid4().hex}"
    return tf.read_token_files(tf.write_token_files(table(spark, sf_dir, "documents"), folder, TOKENIZER))


#: A conversation whose texts hold the template's own control strings.
ODD_TEXT = "\\### Assistant: </turn> ok"


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"),
    )
    return chat.read_back(chat.packs(rows.unionByName(odd)))


ORACLES["op9_chat_format"] = rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS r, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, i, role, role, '{ODD_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length(role) + 14 + length(text) + length(text) - length(replace(text, chr(92), ''))
        + (length(text) - length(replace(text, '</turn>', ''))) // 7
        + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x) - 2)), 0))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rulefit.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rulefit.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


@query
def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


#: The shards of op11_rendezvous_shards, and those with one more.
SHARDS, GROWN = dict.fromkeys(range(8), 1.0), dict.fromkeys(range(9), 1.0)


@query
def op11_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), SHARDS, GROWN)


def _crc_sql(codes: str) -> str:
    """The unsigned CRC-32 of a list of byte values, by the table of the reversed polynomial."""
    entries = []
    for k in range(256):
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        entries.append(k)
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, ({entries}::BIGINT[])[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda x: ('0x' || x)::BIGINT)"


def _op11_sql() -> str:
    drawn = lambda n: f"(SELECT max((('0x' || substr(md5(k || '/' || s), 1, 13))::BIGINT, -s)) FROM range({n}) t(s))"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS k FROM documents),
    s AS (SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, {_crc_sql(_BYTES.format(t="t"))} AS text_crc32, {drawn(len(SHARDS))} AS w, {drawn(len(GROWN))} AS g FROM d)
    SELECT doc_id, size, text_crc32, 'key' AS law, (-w[2])::INTEGER AS shard,
      row_number() OVER (PARTITION BY w[2] ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, (-g[2])::INTEGER AS grown_shard FROM s"""


ORACLES["op11_rendezvous_shards"] = _op11_sql()


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.record_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns])
    # a null id has no decimal, so its rows are not tampered with
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    records = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), merkle.record_digest([F.col(c) for c in columns]).alias("leaf"), F.when(chosen, tampered).alias("changed"))
    made = merkle.manifest(records)
    root = F.lit(made.root).cast("string")
    rows = made.leaves.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def _op12_sql(levels: int = 8) -> str:
    """The trees level by level: a lone node stays as it is, so further levels change nothing."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    capitals = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = []

    def tree(name: str, source: str) -> None:
        """From ``source`` (t, i, h): name0, name1, ... with runs ``kids`` of each node; ``w`` nodes in the tree."""
        steps.append(f"{name}0 AS (SELECT t, i, h, count(*) OVER (PARTITION BY t) AS w FROM {source})")
        for k in range(levels):
            steps.append(f"{name}k{k} AS (SELECT t, i // 8 AS i, list(h ORDER BY i) AS kids, any_value(w) AS w FROM {name}{k} GROUP BY 1, 2)")
            steps.append(f"{name}{k + 1} AS (SELECT t, i, CASE WHEN w = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h, (w + 7) // 8 AS w FROM {name}k{k})")

    def walk(name: str, source: str, t: str, i: str) -> str:
        """``source`` with columns proof and folded carried up the tree."""
        for k in range(levels):
            at = f"(({i} // {8**k}) % 8)"
            left, right = f"array_to_string(kids[1 : {at}], '')", f"array_to_string(kids[{at} + 2 :], '')"
            steps.append(f"""{name}w{k} AS (SELECT s.* EXCLUDE (proof, folded), CASE WHEN w = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
              CASE WHEN w = 1 THEN folded ELSE sha256({left} || folded || {right}) END AS folded
              FROM {source} s JOIN {name}k{k} n ON n.t = s.{t} AND n.i = s.{i} // {8 ** (k + 1)})""")
            source = f"{name}w{k}"
        return source

    steps.append(f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {_crc_sql(_BYTES.format(t='doc_id::VARCHAR'))} % 3 = 0 THEN {leaf(capitals)} END AS changed FROM documents)")
    steps.append("p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, '' AS proof, coalesce(changed, leaf) AS folded FROM d)")
    steps.append("a AS (SELECT tree AS t, place AS i, leaf AS h FROM p)")
    tree("a", "a")
    steps.append(f"r AS (SELECT t AS lang_tree, h AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS slot FROM a{levels})")
    steps.append("b AS (SELECT '' AS t, slot AS i, subroot AS h FROM r)")
    tree("b", "b")
    within = walk("a", "p", "tree", "place")
    steps.append(f"q AS (SELECT *, '' AS whole FROM {within} JOIN r ON lang_tree = tree)")
    up = walk("b", "q", "whole", "slot")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM {up}, b{levels}"


ORACLES["op12_merkle_manifest"] = _op12_sql()


@query
def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summed(*centroids.cluster(table(spark, sf_dir, "embeddings")))


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    near = lambda c: f"""SELECT r, vec_id, v.v, first(k ORDER BY d, k) AS k, min(d) AS d
      FROM (SELECT r, vec_id, v.v, k, list_sum(list_transform(list_zip(v.v, {c}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {c}) v GROUP BY r, vec_id, v.v"""  # noqa: E731
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS ({near(f'c{i}')})")
        steps.append(f"s{i} AS (SELECT k, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY k, j)")
        steps.append(f"c{i + 1} AS (SELECT k, coalesce(m, v) AS v FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY k) USING (k))")
    return f"""
    WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), vec_id NULLS FIRST, v) - 1 AS k, v FROM v QUALIFY k < {k}),
    {', '.join(steps)}, z AS ({near(f'c{rounds}')})
    SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM z JOIN c{rounds} c USING (k)"""


ORACLES["op13_sort_means"] = _op13_sql()
