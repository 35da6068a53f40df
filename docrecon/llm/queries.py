"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docrecon.llm import bpe, fingerprints, langid, licenses, lines, lm, merkle, ngram, packing, quality, search, toxicity, urls
from docrecon.llm.registry import QUERIES, SQL, query, table  # noqa: F401


def digest(column):
    """Lower-case SHA-256 of a binary column, or of a string's UTF-8 form."""
    return F.sha2(F.col(column).cast("binary"), 256)


@query("op1_bpe")
def op1_bpe(spark, sf_dir):
    vocabulary = bpe.read_vocabulary(str(public_tokenizers.path("byte_bpe_50k.json")))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.encode(docs, vocabulary, decoded=True).select(
        "doc_id", "n_tokens", digest("ids").alias("ids_sha256"),
        digest("decoded").alias("decoded_sha256"),
    )


LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, pos, t, lower_az(t) AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)
), owned AS (
  SELECT key, max(doc_id) AS owner FROM line WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT line.*, owner IS NOT NULL AND doc_id <> owner AS gone FROM line LEFT JOIN owned USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""".replace("lower_az(t)", r"""translate(
  regexp_replace(regexp_replace(t, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')""")


@query("op5_lines", LINES_SQL)
def op5_lines(spark, sf_dir):
    kept = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", digest("text").alias("kept_sha256"))


def fold(modulus: int):
    """Fold of a document: crc32 of its id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % modulus


@query("op8_langid")
def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.where(fold(5) != 0))
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


SITES = (
    urls.site_rule("allow", "org", "/"), urls.site_rule("block", "example.org", "/es/"),
    urls.site_rule("block", "example.org", "/en/1"), urls.site_rule("allow", "com", "/fr/"),
    urls.site_rule("block", "com", "/de/"),
)

URLS_SQL = r"""
WITH part AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN
           substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), place AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM part
), rule(h, p, action) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM place JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(path,
         '/(cgi-bin|wp-login\.php|wp-admin|adserver)(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM place LEFT JOIN best USING (page_id)
"""


@query("op9_urls", URLS_SQL)
def op9_urls(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), SITES + urls.GENERIC)


def word_bpe() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe(), end_id=2)


@query("op6_lm")
def op6_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = lm.score(docs, docs.where(fold(10) != 0))
    return scored.withColumn("held_out", fold(10) == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


SHINGLES_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM word
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id
"""


@query("op7_ngram", SHINGLES_SQL)
def op7_ngram(spark, sf_dir):
    return ngram.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_quality")
def op2_quality(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op3_licenses")
def op3_licenses(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    places = F.filter("matches", lambda m: m["phrase"])
    joined = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(F.transform(places, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(places, lambda m: m["first"])).alias("last_word"),
        joined(places).alias("base_labels"), joined("matches").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


@query("op4_fingerprints")
def op4_fingerprints(spark, sf_dir):
    compared = fingerprints.compare_edited(table(spark, sf_dir, "documents", "doc_id", "text"))
    return compared.select(
        "doc_id", "n_chars", digest("edited").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "bands_edited", "bands_next")


# A table of the SQL has one row a node; crc32 is worked out bit by bit.
MERKLE_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, lang, n_chars, row_number() OVER () AS row_id, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda k: 0::BIGINT)),
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS crc,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), hashed AS (
  SELECT *, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN
      sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM doc
), leaf AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM hashed
), node(lang, height, rank, n, digest) AS (
  SELECT lang, 0, rank, n, leaf FROM leaf
  UNION ALL
  SELECT lang, height + 1, rank // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank))
  FROM node WHERE n > 1 GROUP BY lang, height, rank // 2
), top AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM node WHERE n = 1
), upper(height, rank, n, digest) AS (
  SELECT 0, rank, n, subroot FROM top
  UNION ALL
  SELECT height + 1, rank // 2, (any_value(n) + 1) // 2, sha256(string_agg(digest, '' ORDER BY rank))
  FROM upper WHERE n > 1 GROUP BY height, rank // 2
), step AS (
  SELECT own.lang, own.rank, a.height, CASE WHEN b.digest IS NULL THEN 'S' WHEN b.rank < a.rank THEN 'L' || b.digest
           ELSE 'R' || b.digest END AS sibling
  FROM leaf own JOIN node a ON a.lang IS NOT DISTINCT FROM own.lang AND a.rank = own.rank >> a.height AND a.n > 1
  LEFT JOIN node b ON b.lang IS NOT DISTINCT FROM a.lang AND b.height = a.height AND b.rank = xor(a.rank, 1)
), lower_part AS (
  SELECT lang, rank, list(sibling ORDER BY height) AS part FROM step GROUP BY lang, rank
), upper_part AS (
  SELECT top.lang, any_value(top.subroot) AS subroot, list(CASE WHEN b.digest IS NULL THEN 'S' WHEN b.rank < a.rank THEN 'L' || b.digest
           ELSE 'R' || b.digest END ORDER BY a.height) FILTER (a.n IS NOT NULL) AS part
  FROM top LEFT JOIN upper a ON a.rank = top.rank >> a.height AND a.n > 1
  LEFT JOIN upper b ON b.height = a.height AND b.rank = xor(a.rank, 1) GROUP BY top.lang
), proven AS (
  SELECT doc_id, leaf, changed, subroot, (SELECT digest FROM upper WHERE n = 1) AS root,
         coalesce(l.part, []) || coalesce(u.part, []) AS proof
  FROM leaf LEFT JOIN lower_part l ON l.lang IS NOT DISTINCT FROM leaf.lang AND l.rank = leaf.rank
  JOIN upper_part u ON u.lang IS NOT DISTINCT FROM leaf.lang
), done AS (
  SELECT *, list_reduce(list_prepend(coalesce(changed, leaf), proof), lambda x, s: CASE s[1] WHEN 'S' THEN sha256(x)
    WHEN 'L' THEN sha256(s[2:] || x) ELSE sha256(x || s[2:]) END) AS folded_root FROM proven
)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(proof, lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified FROM done
"""


@query("op13_merkle", MERKLE_SQL)
def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    more = [(F.col(c) + 1) if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    made = merkle.manifest(docs, carry={"changed": F.when(hit, merkle.leaf_of(more))})
    folded = made.withColumn("folded_root", merkle.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    siblings = F.transform("proof", lambda s: F.coalesce(merkle.shown(s["sibling"]), F.lit("")))
    return folded.select(
        "doc_id", *[merkle.shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(F.array_join(siblings, "").cast("binary"), 256).alias("proof_sha256"),
        merkle.shown(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


SEARCH_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(terms_in(text)) AS terms FROM documents
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(terms_in(text))) AS term FROM benchmark
), whole AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM doc WHERE len(terms) > 0
), held AS (
  SELECT doc_id, row_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT doc_id, row_id, len(terms) AS n, unnest(terms) AS term FROM doc) GROUP BY doc_id, row_id, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM held, whole GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, row_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM item JOIN held USING (term) JOIN weight USING (term), whole GROUP BY item_id, doc_id, row_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row_id) AS place
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 50
""".replace("terms_in(text)", r"""translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'""")


@query("op11_search", SEARCH_SQL)
def op11_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold(4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
