"""Registered queries of the subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berthwise.llm import cnn, exact, fim, html, langid, merkle, mixing, packing, rules, secrets, simhash, substring, warc
from berthwise.llm.common import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op2_mix_sources(spark, sf_dir):
    m = mixing.mixed(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


@_query
def op6_exact_dedup(spark, sf_dir):
    g = exact.exact_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op6_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""


@_query
def op10_simhash_near_dedup(spark, sf_dir):
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op3_pack_sequences(spark, sf_dir):
    return packing.digest(packing.packed(table(spark, sf_dir, "documents"), word_bpe()))


@_query
def op5_secret_scan(spark, sf_dir):
    """Two deliveries: the ledger of the even ids' texts, then all documents against it."""
    docs = table(spark, sf_dir, "documents")
    before = saved(secrets.scan(docs.where("doc_id % 2 = 0")), "ledger")
    ledger = before.unionByName(saved(secrets.scan(docs, before), "ledger"))
    base = [r.kind for r in secrets.RULES if r.base]
    found = secrets.by_path(docs, ledger, ["doc_id"])
    of = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[of(k) for k in base],
                        F.sha2(secrets.as_text(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
                        secrets.as_text(F.col("found")).alias("spans"))


def _duck_spans(kind: str, pattern: str, keep: str, rank: int) -> str:
    """Spans of one kind: what splitting leaves between the matches places them."""
    return rf"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, stop - len AS start, stop FROM (
  SELECT doc_id, length(m) AS len, m, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS b, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS bs FROM d)))
  WHERE {keep}"""


_ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
           r"[aA][pP][iI]_?[kK][eE][yY])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)")
ORACLES["op5_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_duck_spans('assign', _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8", 0)}
UNION ALL {_duck_spans('access', 'AKIA[A-Z0-9]+', 'len >= 16', 1)}
UNION ALL {_duck_spans('hex', '[0-9a-f]+', 'len >= 32', 2)}
UNION ALL {_duck_spans('github', 'gh[pousr]_[A-Za-z0-9]{36,}', 'len >= 40', 3)}
UNION ALL {_duck_spans('private_key', '-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----', 'len >= 1', 4)}),
w AS (SELECT *, kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS x FROM s),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
  count(*) FILTER (rank = 2) AS n_hex, string_agg(x, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(x, ',' ORDER BY start, rank) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id"""


@_query
def op1_quality_rules(spark, sf_dir):
    return rules.judged(table(spark, sf_dir, "documents")).drop("failed_rule")


ORACLES["op1_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n - ln.u, 0) AS n_dup_lines,
  coalesce(ln.n, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper_n, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
  length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN ln ON d.doc_id = ln.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_symbols <= n_words AND 2 * n_words <= word_chars
    AND word_chars <= 15 * n_words AND (n_dup_lines < 3 OR 10 * n_dup_lines <= 3 * n_lines) AND 2 * upper_n <= letters AND 10 * marks <= n_words AS kept
FROM m"""


@_query
def op8_language_crf(spark, sf_dir):
    out = langid.identified(table(spark, sf_dir, "documents"))
    return out.select("doc_id", (~langid.in_training()).alias("held_out"), "lang_pred", "score")


@_query
def op9_quality_cnn(spark, sf_dir):
    out = cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (~langid.in_training()).alias("held_out"), "score",
                      F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_query
def op4_warc_bundles(spark, sf_dir):
    r = warc.read(warc.archived(table(spark, sf_dir, "pages")), with_payload=False)
    return r.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    warc.page_of(F.col("refers_to")).alias("refers_to"))


ORACLES["op4_warc_bundles"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
q AS (SELECT *, [CAST('0x' || x[5 * i + 1:5 * i + 5] AS BIGINT) for i in range(8)] AS v FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string([(
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1] for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM q"""


@_query
def op7_substring_dedup(spark, sf_dir):
    c = substring.cleaned(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
word AS (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
mark AS (SELECT word.doc_id, word.i, x, max(later.i) OVER (PARTITION BY word.doc_id ORDER BY word.i) AS last
  FROM word LEFT JOIN later ON word.doc_id = later.doc_id AND word.i = later.i),
r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (last IS NOT NULL AND last + 19 >= i) AS gone,
  string_agg(x, ' ' ORDER BY i) FILTER (last IS NULL OR last + 19 < i) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""


@_query
def op11_fill_in_middle(spark, sf_dir):
    made = fim.with_restored(fim.transformed(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || x[1:8] AS BIGINT) AS h1,
  CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


@_query
def op12_html_main_text(spark, sf_dir):
    return html.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


# The given pages hold their text in one article of headings and paragraphs.
ORACLES["op12_html_main_text"] = r"""
WITH a AS (SELECT page_id, url, split_part(split_part(coalesce(html, ''), '<article>', 2), '</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, unnest(string_split_regex(h, '</?(p|h1)>')) AS x, unnest(range(len(string_split_regex(h, '</?(p|h1)>')))) AS i FROM a),
t AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'),
  '\s+', ' ', 'g'), '&quot;', '"', 'g'), '&amp;?', '&', 'g')) AS x FROM b),
g AS (SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS text FROM t WHERE x <> '' GROUP BY page_id)
SELECT a.page_id, a.url, coalesce(g.text, '') AS text, CAST(length(coalesce(g.text, '')) AS BIGINT) AS n_chars
FROM a LEFT JOIN g ON a.page_id = g.page_id"""


def tampered() -> F.Column:
    """The documents whose character count is raised by one: ids with a CRC-32 that 7 divides."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


@_query
def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    leaf = lambda n: merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"),
                         F.when(tampered(), leaf(F.col("n_chars") + 1)).alias("tampered"))
    m = merkle.manifest(leaves, "leaf", "doc_id", "lang")
    shown = F.coalesce(F.col("row.tampered"), F.col("row.leaf"))
    m = m.select("row.doc_id", "row.leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
                 merkle.folded(shown, F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def _enc(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_enc(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _nodes(name: str, base: str) -> str:
    """All nodes (k: tree, l: level, i: index, n: nodes of the level) above the base's leaves."""
    return f"""{name}(k, l, i, n, h) AS ({base}
  UNION ALL SELECT k, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, l, i // 2, n)"""


# zlib's CRC-32, bit by bit; trees level by level; proofs by index; folding step by step.
ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE crc(s, b, c) AS (SELECT CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT s, b + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM (
    SELECT s, b, CASE WHEN b % 8 = 0 THEN xor(c, CAST(ascii(s[b // 8 + 1]) AS BIGINT)) ELSE c END AS x FROM crc WHERE b < 8 * length(s))),
bad AS (SELECT DISTINCT CAST(s AS BIGINT) AS doc_id FROM crc WHERE b = 8 * length(s) AND xor(c, 4294967295) % 7 = 0),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf('n_chars')} AS leaf, {_leaf('n_chars + 1')} AS leaf1 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
{_nodes('t', "SELECT k, 0, i, n, leaf FROM r")},
sub AS (SELECT k, l AS high, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_nodes('u', "SELECT 'all', 0, i, n, h FROM sub")},
top AS (SELECT h FROM u WHERE n = 1),
steps AS (SELECT r.doc_id, r.leaf, a.l AS pos, r.i >> a.l AS i, b.h FROM r JOIN (SELECT DISTINCT k, l FROM t WHERE n > 1) a ON a.k = r.k
    LEFT JOIN t b ON b.k = r.k AND b.l = a.l AND b.i = xor(r.i >> a.l, 1)
  UNION ALL SELECT r.doc_id, r.leaf, sub.high + a.l, sub.i >> a.l, b.h FROM r JOIN sub ON sub.k = r.k
    CROSS JOIN (SELECT DISTINCT l FROM u WHERE n > 1) a LEFT JOIN u b ON b.l = a.l AND b.i = xor(sub.i >> a.l, 1)),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY pos), '')) AS p, count(*) AS n FROM steps GROUP BY doc_id),
f(doc_id, pos, h) AS (SELECT d.doc_id, 0, CASE WHEN bad.doc_id IS NULL THEN leaf ELSE leaf1 END FROM d LEFT JOIN bad ON bad.doc_id = d.doc_id
  UNION ALL SELECT f.doc_id, f.pos + 1, sha256(CASE WHEN s.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
    FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.pos = f.pos),
last AS (SELECT doc_id, arg_max(h, pos) AS h FROM f GROUP BY doc_id)
SELECT d.doc_id, d.leaf, sub.h AS subroot, top.h AS root, coalesce(proof.p, sha256('')) AS proof_sha256, last.h AS folded_root, last.h = top.h AS verified
FROM d JOIN sub ON sub.k = d.k CROSS JOIN top JOIN last ON last.doc_id = d.doc_id LEFT JOIN proof ON proof.doc_id = d.doc_id"""
