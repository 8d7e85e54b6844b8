"""The registered queries of this subpackage, one per operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, contamination, divergence, exact, language, neardup, pii, sharding, spelling, substring, toxicity, urls
from .common import table


#: A conversation of control strings, formatted beside the table's.
_TRAP = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRAP).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return chat.digests(chat.render(chat.fold_events(chat.as_log(rows))))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: host/path rules of the url filter.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents")
    lexicon = urls.count_words(docs.select("text"), pages.select("html"), pages.select("url"))
    return urls.judge(pages, URL_RULES, urls.fit(urls.parsed(pages, URL_RULES), lexicon, URL_RULES, docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.strip_repeats(table(spark, sf_dir, "documents")))


def repeat_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each repeated window of ``op5_substring_dedup`` goes on being repeated: its levels doubled until none survives."""
    return substring.longest_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {"op1_chat_format": op1_chat_format, "op2_decontaminate": op2_decontaminate, "op3_url_filter": op3_url_filter, "op4_toxicity": op4_toxicity, "op5_substring_dedup": op5_substring_dedup, "op6_language_id": op6_language_id, "op7_pii": op7_pii, "op8_byte_bpe": op8_byte_bpe, "op9_near_dedup": op9_near_dedup, "op10_exact_dedup": op10_exact_dedup, "op11_spelling_variants": op11_spelling_variants, "op12_sharding": op12_sharding, "op13_source_divergence": op13_source_divergence, "repeat_lengths": repeat_lengths}

ORACLE_SQL = {
    "op1_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (SELECT conv_id, turn, role, text, role = 'assistant' AS loss,
                     length('<|turn|>' || role || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10)) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE loss), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op2_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
             iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
             ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
             qs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw)),
             n AS (SELECT item_id, count(*) AS n_shingles FROM qs GROUP BY item_id),
             m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN qs USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment
        FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8 * n_shingles
    """,
    "op5_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
             least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
             hit AS (SELECT DISTINCT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > first),
             gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
             each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op10_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op11_spelling_variants": """
        WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
             run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
             each AS (SELECT doc_id, r, count(*) AS n FROM run GROUP BY ALL),
             bytes AS (SELECT doc_id, r, n, list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))) AS b FROM each),
             hashed AS (SELECT r, n, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1]))) AS h FROM bytes, tab),
             written AS (SELECT CASE WHEN h % 97 = 0 THEN substring(r, 1, (h % length(r))::INT) || substring(r, (h % length(r))::INT + 2) ELSE r END AS word, n FROM hashed),
             w AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
             cut AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
             near AS (SELECT a.word, a.n, b.word AS d, b.n AS dn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                      UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
                      UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
             best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -dn, d := d)) AS m FROM near GROUP BY word),
             f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 2 * n THEN m.d END AS form, CASE WHEN -m.less >= 2 * n THEN -m.less END AS form_n FROM w LEFT JOIN best USING (word)),
             walk AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, arg_max(root, step) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
        FROM f JOIN walk USING (word) GROUP BY f.word, form
    """,
    "op13_source_divergence": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t, row_number() OVER () AS row FROM documents),
             o AS (SELECT row, lang, source, translate(unnest(t), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
             k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 30),
             l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
             c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
             g AS (SELECT g.lang, g.source, coalesce(any_value(v), 0) AS v, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
             q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v)::HUGEINT AS q FROM k JOIN l USING (lang)),
             p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * g.v)::HUGEINT AS p
                   FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
             pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                       LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
                       UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 50
    """,
}
