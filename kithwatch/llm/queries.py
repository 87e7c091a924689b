"""One query per operator over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kithwatch.llm.balance import pack_balanced
from kithwatch.llm.decontamination import contamination
from kithwatch.llm.fingerprints import compare_with_next
from kithwatch.llm.jaccard import jaccard_components
from kithwatch.llm.kneser_ney import score_texts, train
from kithwatch.llm.language import identify_language, learn_prototypes
from kithwatch.llm.lexical import search
from kithwatch.llm.licenses import scan_licenses
from kithwatch.llm.negatives import mine, quantized
from kithwatch.llm.packing import pack_best_fit, tokenized_pieces
from kithwatch.llm.pii import find_personal_data
from kithwatch.llm.repeats import remove_repeats
from kithwatch.llm.urls import judge_urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(_table(spark, folder, "documents"), size=3, least=90, of=100)


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    # The vocabulary files are installed with the tokenizers, on executors too.
    import public_tokenizers

    pieces = tokenized_pieces(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pack_best_fit(pieces)


def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(_table(spark, folder, "documents"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(_table(spark, folder, "documents"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    prototypes = learn_prototypes(documents.where(_fold(5) != 0))
    found = identify_language(documents.select("doc_id", "text"), prototypes)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    scored = score_texts(documents, train(documents.where(_fold(7) != 2)))
    held_out = F.coalesce(_fold(7) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(_table(spark, folder, "pages"))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_next(_table(spark, folder, "documents"))


def op10_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), k=20)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = quantized(_table(spark, folder, "embeddings"), scale=256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_balanced(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# What of operators 3, 4, 7, 8 and 9 SQL can say: their base columns, from the operators' own results.


def personal_data_counts(spark: SparkSession, folder: str) -> DataFrame:
    return op3_personal_data(spark, folder).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def license_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return op4_license_scan(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def language_model_base(spark: SparkSession, folder: str) -> DataFrame:
    base = F.round("base_score", 6).alias("base_score")
    return op7_kneser_ney(spark, folder).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base)


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return op8_url_filter(spark, folder).select("page_id", "host", "path", "rule")


def fingerprint_edits(spark: SparkSession, folder: str) -> DataFrame:
    return op9_fingerprints(spark, folder).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_personal_data": op3_personal_data,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_url_filter": op8_url_filter,
    "op9_fingerprints": op9_fingerprints,
    "op10_repeated_strings": op10_repeated_strings,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_balanced_packing": op13_balanced_packing,
    "personal_data_counts": personal_data_counts,
    "license_phrases": license_phrases,
    "language_model_base": language_model_base,
    "url_rules": url_rules,
    "fingerprint_edits": fingerprint_edits,
}

# Words between white space, and words of ASCII letters, digits and anything beyond ASCII.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_WORDED = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _crc32(text: str) -> str:
    """The checksum of an ASCII text, bit by bit."""
    byte = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295)"


ORACLE: dict[str, str] = {
    # Every pair of documents with a common shingle, then links one by one. Ids are told apart.
    "op1_ngram_jaccard": f"""WITH RECURSIVE texts AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS grams
  FROM texts
),
held AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
parts(id, component) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT e.b, min(c.component) FROM parts c JOIN ends e ON e.a = c.id JOIN recurring.parts r ON r.id = e.b
  WHERE c.component < r.component GROUP BY e.b
)
SELECT doc_id, len(grams)::BIGINT AS n_shingles, component AS component_id FROM sets JOIN parts ON id = doc_id""",
    # Every window of every document beside every window of every item.
    "op5_decontamination": f"""WITH texts AS (SELECT row_number() OVER () AS d, doc_id, coalesce({_WORDED}, []) AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDED} AS w FROM benchmark) WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS text
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM items)
),
windows AS (
  SELECT d, i, size, array_to_string(w[i : i + size - 1], ' ') AS text
  FROM (SELECT d, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM texts, (SELECT DISTINCT size FROM wanted) WHERE len(w) >= size)
),
found AS (SELECT d, i, size, item_id FROM windows JOIN wanted USING (size, text)),
hit AS (SELECT d, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT d, unnest(range(i, i + size)) AS place FROM found) GROUP BY d),
named AS (
  SELECT d, count(*)::BIGINT AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT d, item_id::VARCHAR AS name FROM found) GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM texts LEFT JOIN hit USING (d) LEFT JOIN named USING (d)""",
    # Every 200 bytes at every place, as hexadecimal text.
    "op10_repeated_strings": """WITH texts AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT d, i, md5_number(substr(h, 2 * i + 1, 400)) AS part
  FROM (SELECT d, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM texts WHERE len(h) >= 400)
),
again AS (SELECT d, i FROM starts QUALIFY count(*) OVER (PARTITION BY part) > 1),
spans AS (
  SELECT d, min(i) AS low, max(i) + 200 AS high
  FROM (SELECT d, i, sum(CASE WHEN i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS run
        FROM (SELECT d, i, coalesce(lag(i) OVER (PARTITION BY d ORDER BY i), i) AS before FROM again))
  GROUP BY d, run
),
gaps AS (
  SELECT d, coalesce(lag(high) OVER (PARTITION BY d ORDER BY low), 0) AS first, low AS last FROM spans
  UNION ALL SELECT d, max(high), NULL FROM spans GROUP BY d
),
kept AS (
  SELECT d, string_agg(substr(h, 2 * first + 1, 2 * (coalesce(last, len(h) // 2) - first)), '' ORDER BY first) AS rest
  FROM gaps JOIN texts USING (d) GROUP BY d
),
sizes AS (SELECT d, sum(high - low)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM spans GROUP BY d)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM texts LEFT JOIN sizes USING (d) LEFT JOIN kept USING (d)""",
    "personal_data_counts": r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id,
    regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
    list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
      lambda m: len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 256) > 255)) = 0) AS ip,
    list_filter(list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')),
      lambda d: len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, len(d)), lambda i:
        CASE WHEN i % 2 = 0 THEN substr(d, len(d) - i, 1)::INTEGER
        ELSE 2 * substr(d, len(d) - i, 1)::INTEGER - 9 * (substr(d, len(d) - i, 1) > '4')::INTEGER END)) % 10 = 0) AS card,
    list_filter(list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')),
      lambda d: len(d) BETWEEN 10 AND 15) AS phone
  FROM texts
)
SELECT doc_id, len(email)::BIGINT AS n_email, len(ip)::BIGINT AS n_ip, len(card)::BIGINT AS n_card, len(phone)::BIGINT AS n_phone FROM found""",
    "license_phrases": f"""WITH texts AS (SELECT row_number() OVER () AS d, doc_id, coalesce({_WORDED}, []) AS w FROM documents),
phrases AS (
  SELECT string_split(phrase, ' ') AS p, label
  FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) AS v(phrase, label)
),
found AS (
  SELECT d, i - 1 AS place, label FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS i FROM texts), phrases
  WHERE w[i : i + len(p) - 1] = p
),
base AS (
  SELECT d, count(*)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM found GROUP BY d
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels
FROM texts LEFT JOIN base USING (d)""",
    "language_model_base": f"""WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id, list_append(coalesce({_SPACED}, []), chr(10)) AS w, {_crc32('doc_id::VARCHAR')} % 7 = 2 AS held_out
  FROM documents
),
tokens AS (SELECT d, held_out, unnest(w) AS token FROM texts),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
total AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM counts),
scores AS (
  SELECT d, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS score
  FROM tokens LEFT JOIN counts USING (token), total GROUP BY d
)
SELECT doc_id, held_out, n_tokens, n_known, n AS train_tokens, round(score, 6) AS base_score
FROM texts JOIN scores USING (d), total""",
    "url_rules": r"""WITH parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parsed),
places AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path
  FROM split
),
rules AS (
  SELECT rule, substr(rule, 1, strpos(rule, '/') - 1) AS h, substr(rule, strpos(rule, '/')) AS p
  FROM (VALUES ('com/'), ('example.com/en/'), ('www.example.com/en/'), ('net/es/'), ('net/fr/')) AS v(rule)
)
SELECT page_id, host, path,
       (SELECT arg_max(rule, len(rule)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule
FROM places""",
    "fingerprint_edits": """WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS following,
         first(coalesce(text, '')) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS start
  FROM documents
)
SELECT doc_id, length(t)::BIGINT AS n_chars,
       sha256(substr(t, 1, length(t) - length(t) // 4) || substr(coalesce(following, start), 1, length(t) // 4)) AS edited_sha256
FROM texts""",
    # Every document is scored for every item.
    "op11_ranked_search": f"""WITH texts AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT d, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM texts) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, docs
),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL
),
scores AS (
  SELECT item_id, doc_id, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total.terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (d), total GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""",
    # Every anchor with every row.
    "op12_hard_negatives": """WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5""",
}
