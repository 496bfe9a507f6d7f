"""Registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.chat import chain, chat_digests
from lodestrata.llm.divergence import source_divergence
from lodestrata.llm.fingerprints import version_fingerprints
from lodestrata.llm.html import extract_main_text
from lodestrata.llm.jaccard import near_documents
from lodestrata.llm.langid import predict_languages
from lodestrata.llm.mixing import mix_sources
from lodestrata.llm.neighbours import near_vectors
from lodestrata.llm.prefixes import conversations_of, prefix_trie, rebuilt
from lodestrata.llm.secrets import secret_digests
from lodestrata.llm.substrings import remove_repeats
from lodestrata.llm.tokens import count_tokens, encode_pieces


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), path=public_tokenizers.path("byte_bpe_50k.json"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(_read(spark, sf_dir, "documents"), words=3, percent=90)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_fingerprints(_read(spark, sf_dir, "documents"))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(_read(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_read(spark, sf_dir, "documents"), path=public_tokenizers.path("piece_bpe_32k.model"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    own = spark.sql(r"""select * from values (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') as t(conv_id, turn, role, text)""")
    return chat_digests(chain(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_read(spark, sf_dir, "pages"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(conversations_of(_read(spark, sf_dir, "conversations"))))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_near_vectors": op1_near_vectors, "op2_token_counts": op2_token_counts, "op3_jaccard": op3_jaccard, "op4_fingerprints": op4_fingerprints, "op5_languages": op5_languages, "op6_pieces": op6_pieces, "op7_secrets": op7_secrets, "op8_mixing": op8_mixing, "op9_chat": op9_chat, "op10_main_text": op10_main_text, "op11_substrings": op11_substrings, "op12_prefix_trie": op12_prefix_trie, "op13_divergence": op13_divergence}


COMPONENTS = """walk(id, c) AS (SELECT id, id FROM nodes UNION SELECT links.b, walk.c FROM walk JOIN links ON links.a = walk.id), comp AS (SELECT id, min(c) component_id FROM walk GROUP BY id)"""

ORACLE = {
    "op1_near_vectors": f"""WITH RECURSIVE v AS (SELECT vec_id id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.id a, q.id b FROM v p JOIN v q ON p.id <> q.id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95), nodes AS (SELECT vec_id id FROM embeddings), {COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) n_links, component_id, vec_id = component_id kept FROM embeddings JOIN comp ON id = vec_id""",
    "op3_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') p FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(p) >= 3 THEN list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i : i + 2], ' ')) WHEN len(p) > 0 THEN [array_to_string(p, ' ')] ELSE [] END) sh FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), links AS (SELECT p.doc_id a, q.doc_id b FROM s p JOIN s q ON p.sh = q.sh AND p.doc_id <> q.doc_id JOIN n x ON x.doc_id = p.doc_id JOIN n y ON y.doc_id = q.doc_id GROUP BY 1, 2 HAVING 190 * count(*) >= 90 * (any_value(x.n) + any_value(y.n))), nodes AS (SELECT doc_id id FROM documents), {COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON id = d.doc_id""",
    "op9_chat": r"""WITH own AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
e AS (SELECT *, replace(replace(replace(t, '\', '\b'), '</turn>', '\e'), '### ', '\h') et, replace(replace(replace(replace(r, '\', '\b'), '</turn>', '\e'), '### ', '\h'), ': ', '\c') er FROM own)
SELECT conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) turns_sha256, coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) loss_sha256, sum(14 + length(er) + length(et))::BIGINT formatted_chars FROM e GROUP BY conv_id""",
    "op11_substrings": """WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') p FROM documents),
w AS (SELECT r, i, md5(array_to_string(p[i : i + 34], ' ')) h FROM d, unnest(range(1, len(p) - 33)) x(i)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), gone AS (SELECT DISTINCT r, i + k AS i FROM w JOIN twice USING (h), range(0, 35) y(k)),
g AS (SELECT r, list(i) g FROM gone GROUP BY r), k AS (SELECT d.r, string_agg(p[i], ' ' ORDER BY i) kept, count(i) n FROM d, unnest(range(1, len(p) + 1)) x(i) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = d.r AND gone.i = x.i) GROUP BY d.r)
SELECT doc_id, len(p)::BIGINT n_words, (len(p) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256 FROM d LEFT JOIN k ON k.r = d.r""",
    "op12_prefix_trie": """WITH t AS (SELECT conv_id, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda v, s: list_reduce([xor(v, s), 0, 0, 0, 0, 0, 0, 0, 0], lambda z, _: xor(z >> 1, CASE WHEN z & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 h FROM t),
re AS (SELECT c, k, r, x FROM c JOIN t ON t.conv_id = c.c - c.c % 20 AND k <= h UNION ALL SELECT c, k + 4, r, x FROM c JOIN t ON t.conv_id = c.c AND k > h),
l AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) d, md5(r || chr(0) || x) m, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) w FROM re),
p AS (SELECT c, d, w, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) id FROM l UNION ALL SELECT c, 0, 0, '' FROM c),
e AS (SELECT c, max(d) d FROM p GROUP BY c), node AS (SELECT id, any_value(d) d, min(c) conv_id, count(*) n, any_value(w) w FROM p GROUP BY id),
last AS (SELECT id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) s FROM p JOIN e USING (c, d) GROUP BY id),
up AS (SELECT substr(id, 1, greatest(length(id) - 32, 0)) pid, count(*) k FROM node WHERE d > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(k, 0) k FROM node LEFT JOIN up ON pid = id),
sums AS (SELECT substr(id, 1, 32 * i) a, count(*) FILTER (k = 0) leaves, sum((n - 1) * w) saved FROM own, unnest(range(0, d + 1)) x(i) GROUP BY 1)
SELECT o.conv_id, o.d::BIGINT AS depth, q.conv_id parent_conv_id, o.n n_convs, o.k n_children, leaves n_leaves, saved::BIGINT saved_tokens, coalesce(s, sha256('')) ends_sha256
FROM own o JOIN sums ON a = o.id LEFT JOIN last ON last.id = o.id LEFT JOIN node q ON o.d > 0 AND q.id = substr(o.id, 1, greatest(length(o.id) - 32, 0))""",
    "op13_divergence": """WITH t AS (SELECT row_number() OVER () r, coalesce(lang, '') l, coalesce(source, '') s, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') p FROM documents),
e AS (SELECT r, l, s, unnest(p) t FROM t), kept AS (SELECT l, t, count(*) n FROM e GROUP BY l, t HAVING count(DISTINCT r) >= 10), g AS (SELECT DISTINCT l, s FROM t),
size AS (SELECT l, count(*) v, sum(n) n FROM kept GROUP BY l), c AS (SELECT e.l, s, e.t, count(*) n FROM e JOIN kept ON kept.l = e.l AND kept.t = e.t GROUP BY ALL), total AS (SELECT l, s, sum(n) n FROM c GROUP BY l, s),
p AS (SELECT g.l, g.s, kept.t, coalesce(c.n, 0) n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(total.n, 0) + 2 * v))::BIGINT p, (1 + 1000000000::HUGEINT * (kept.n + 2) // (size.n + 2 * v))::BIGINT q
  FROM g JOIN kept ON kept.l = g.l JOIN size ON size.l = g.l LEFT JOIN c ON c.l = g.l AND c.s = g.s AND c.t = kept.t LEFT JOIN total ON total.l = g.l AND total.s = g.s),
f AS (SELECT a.l, a.s, b.s item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT f FROM p a JOIN p b ON a.l = b.l AND a.t = b.t AND a.s <> b.s GROUP BY ALL),
r AS (SELECT a.l, a.s, 'pair' part, b.s item, coalesce(f, 0)::BIGINT f FROM g a JOIN g b ON a.l = b.l AND a.s <> b.s LEFT JOIN f ON f.l = a.l AND f.s = a.s AND f.item = b.s
  UNION ALL SELECT l, s, 'term', t, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT l lang, s AS source, part, item, f AS "value", rank FROM (SELECT *, row_number() OVER (PARTITION BY l, s, part ORDER BY f DESC, item)::INTEGER rank FROM r) WHERE part = 'pair' OR rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can state a query; the others are held against brute force,
    a library, a round trip or held-out texts in the tests."""
    return dict(ORACLE)
