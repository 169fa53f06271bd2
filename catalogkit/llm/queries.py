"""Every operator of this subpackage over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_words, cover_tree, decontaminate, language_id, maxent_lm, merkle, packing, prefix_trie, ranking, simhash, substrings, token_counts, toxicity,
)

QUERIES = {}
SQL = {}


def query(fn=None, *, sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows where there is one."""
    if fn is None:
        return lambda own: query(own, sql=sql)
    QUERIES[fn.__name__] = fn
    if sql:
        SQL[fn.__name__] = sql
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = ranking.held_out(language_id.FOLDS, 0)
    learned = docs.filter(~test & F.col("doc_id").isNotNull())
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(learned))
    return found.select("doc_id", test.alias("held_out"), "lang_pred", "score")


@query
def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.deduplicate(docs, kept_text=False)


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    test = ranking.held_out(toxicity.FOLDS, toxicity.TEST_FOLD)
    model = toxicity.train(docs.filter(~test), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", test.alias("held_out"), "score", "predicted")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


@query
def op10_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    test = ranking.held_out(ranking.FOLDS, 0)
    model = ranking.train(docs.filter(~test), table(spark, sf_dir, "labels"))
    return ranking.score(docs, model).select("doc_id", test.alias("held_out"), "score", "predicted")


@query
def op11_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.round_trip(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (ord(c)::BIGINT >> k) & 1)))"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), {step}), 4294967295)"


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _climb(name: str, nodes: str) -> str:
    return f"""{name} AS ({nodes} UNION ALL
      SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 8, n)"""


def _siblings(name: str, leaves: str, first: str) -> str:
    """Siblings on the way up from a leaf, left and right of it."""
    own = f"({leaves}.i // (8 ** s.level)::BIGINT)"
    return f"""SELECT {leaves}.row, {first} + s.level AS step, coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i < {own}), '') AS a,
      coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i > {own}), '') AS b
      FROM {leaves} JOIN {name} s ON s.tree = {leaves}.tree AND s.n > 1 AND s.i // 8 = {own} // 8 GROUP BY ALL"""


MANIFEST_SQL = f"""WITH RECURSIVE
  rows AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(_LOWER)}) END AS changed FROM documents),
  leaves AS (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, changed NULLS FIRST) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM rows),
  {_climb('nodes', 'SELECT tree, 0::BIGINT AS level, i, n, leaf AS d FROM leaves')},
  subroots AS (SELECT tree AS name, level AS height, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d FROM nodes WHERE n = 1),
  {_climb('tops', 'SELECT tree, 0::BIGINT AS level, i, n, d FROM subroots')},
  upper AS (SELECT l.row, s.tree, s.i, s.height FROM leaves l JOIN subroots s ON s.name = l.tree),
  proofs AS ({_siblings('nodes', 'leaves', '0')} UNION ALL {_siblings('tops', 'upper', 'upper.height')}),
  folds AS (SELECT row, 0::BIGINT AS step, coalesce(changed, leaf) AS d FROM leaves
    UNION ALL SELECT f.row, f.step + 1, sha256(p.a || f.d || p.b) FROM folds f JOIN proofs p ON p.row = f.row AND p.step = f.step),
  told AS (SELECT row, sha256(string_agg(a || b, '' ORDER BY step)) AS proof FROM proofs GROUP BY row)
SELECT l.doc_id, l.leaf, s.d AS subroot, t.d AS root, coalesce(told.proof, sha256('')) AS proof_sha256, f.d AS folded_root, f.d = t.d AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN tops t ON t.n = 1 LEFT JOIN told ON told.row = l.row
JOIN (SELECT row, max_by(d, step) AS d FROM folds GROUP BY row) f ON f.row = l.row"""


@query(sql=MANIFEST_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""WITH
  given AS (SELECT conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  keyed AS (SELECT conv, turn, sha256(strlen(role) || ':' || role || text) AS key, length(text) AS chars FROM given),
  own AS (SELECT conv, key, chars, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, key) - 1 AS place FROM keyed),
  convs AS (SELECT conv, conv - conv % 100 AS base, {_crc32('conv::VARCHAR')} % 6 AS taken FROM (SELECT DISTINCT conv FROM own)),
  built AS (SELECT c.conv, 0 AS part, o.place, o.key, o.chars FROM convs c JOIN own o ON o.conv = c.base AND o.place < c.taken
    UNION ALL SELECT c.conv, 1, o.place, o.key, o.chars FROM convs c JOIN own o ON o.conv = c.conv AND o.place >= c.taken),
  turns AS (SELECT conv, key, chars, row_number() OVER (PARTITION BY conv ORDER BY part, place) AS depth FROM built),
  steps AS (SELECT conv, depth, chars, string_agg(key, '') OVER (PARTITION BY conv ORDER BY depth) AS node FROM turns
    UNION ALL SELECT conv, 0, 0, '' FROM convs),
  sized AS (SELECT *, max(depth) OVER (PARTITION BY conv) AS len FROM steps),
  nodes AS (SELECT node, depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (len = depth), '')) AS ends_sha256 FROM sized GROUP BY node, depth),
  children AS (SELECT left(node, length(node) - 64) AS node, count(*) AS n_children FROM nodes WHERE node != '' GROUP BY 1),
  sums AS (SELECT a.node, count(*) FILTER (c.n_children IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens
    FROM nodes a JOIN nodes b ON left(b.node, length(a.node)) = a.node LEFT JOIN children c ON c.node = b.node GROUP BY a.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN nodes p ON n.node != '' AND p.node = left(n.node, length(n.node) - 64)"""


@query(sql=TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
