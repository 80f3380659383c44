"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltcellar.llm import alignment, backoff, chat, decontaminate, embeddings, jaccard, licenses, linededup, mixing, quality, ranking, secrets, toxicity
from saltcellar.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]

# How the mix is defined, in SQL: a full sort takes the place of the histograms.
SIZES_SQL = r"""
SELECT doc_id, source, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS hash,
       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
FROM {documents}
"""
MIX_SQL = r"""
sized AS ({sizes}),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS weight, source_size * 3 AS most FROM totals
),
filling AS (
  SELECT *, most::DOUBLE / weight AS fills_at,
    (sum(source_size) OVER () - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY most::DOUBLE / weight, source COLLATE "binary" NULLS LAST)
),
targets AS (
  SELECT source, source_size,
    CASE WHEN fills_at <= level THEN most::DOUBLE ELSE max(CASE WHEN fills_at > level THEN level END) OVER () * weight END AS target
  FROM filling
),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
),
by_hash AS (SELECT source AS of, hash, sum(size)::BIGINT AS held, count(*) AS n FROM sized GROUP BY source, hash),
upto AS (SELECT *, sum(held) OVER (PARTITION BY of ORDER BY hash) AS upto FROM by_hash),
edges AS (
  SELECT source, min(hash) AS cut, min_by(CASE WHEN held > 0 THEN floor((rest - (upto - held)) * n / held + 0.5) ELSE 0 END, hash)::BIGINT AS extra
  FROM (SELECT *, least(target - whole * source_size, source_size::DOUBLE) AS rest FROM shares) s JOIN upto ON of IS NOT DISTINCT FROM source
  WHERE upto >= rest GROUP BY source
),
mixed AS (
  SELECT z.doc_id, z.size, h.source_size, h.target, least(h.whole + (z.hash < e.cut OR (z.hash = e.cut AND z.place <= e.extra))::BIGINT, 3) AS copies
  FROM (SELECT *, row_number() OVER (PARTITION BY source, hash) AS place FROM sized) z JOIN shares h ON z.source IS NOT DISTINCT FROM h.source JOIN edges e ON e.source IS NOT DISTINCT FROM h.source
)
"""


def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_licenses", F.array_join("licenses.template", ",").alias("licenses"),
                        F.coalesce(F.array_min("licenses.containment"), F.lit(0.0)).alias("least_containment"))


def op2_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = backoff.score_corpus(table(spark, folder, "documents"))
    return scored.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log_score")])


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op4_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that is nothing but control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], turns.schema)
    return chat.digests(chat.format_trees(chat.threads(turns.union(probe))))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_exact", "n_near")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the test items found in it; the list is empty for clean ones."""
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_items", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"),
                        (F.col("n_items") > 0).alias("contaminated"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"))


# Plain levenshtein over all pairs of lines whose lengths allow it takes the place of the segment index.
LINES_SQL = """
lines AS (
  SELECT doc_id, pos - 1 AS pos, line, lower(trim(line, ' ')) AS norm
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {documents})
),
judged AS (SELECT * FROM lines WHERE length(norm) >= 10),
kinds AS (SELECT norm, min(doc_id * 1000000 + pos) AS first, length(norm) AS size FROM judged GROUP BY norm),
near AS (
  SELECT DISTINCT b.norm FROM kinds a JOIN kinds b
  ON b.size BETWEEN a.size - 2 AND a.size + 2 AND a.first < b.first AND a.size >= 40 AND b.size >= 40
  WHERE levenshtein(a.norm, b.norm) <= 2
),
marked AS (
  SELECT l.*, coalesce(k.first <> l.doc_id * 1000000 + l.pos, false) AS exact, n.norm IS NOT NULL AND length(l.norm) >= 10 AS near
  FROM lines l LEFT JOIN kinds k ON k.norm = l.norm AND length(l.norm) >= 10 LEFT JOIN near n ON n.norm = l.norm
),
deduped AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT exact AND NOT near), '') AS text, count(*)::INT AS n_lines,
         count(*) FILTER (WHERE exact)::INT AS n_exact, count(*) FILTER (WHERE near AND NOT exact)::INT AS n_near
  FROM marked GROUP BY doc_id
)
"""

# The kinds as the scan defines them, with the lengths of the base kinds tested after the match.
SECRET_KINDS_SQL = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
    "forge": (r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "private": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27),
    "login": (r"[a-z]{3,10}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1, 6),
}


def _secrets_sql() -> str:
    kinds = "\nUNION ALL\n".join(
        f"""SELECT doc_id, source, {rank} AS rank, '{name}' AS kind, {least} AS least, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps,
          regexp_extract_all(coalesce(text, ''), '{pattern}', 0) AS found, regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS secrets
          FROM documents"""
        for rank, (name, (pattern, group, least)) in enumerate(SECRET_KINDS_SQL.items())
    )
    return f"""
WITH matched AS ({kinds}),
each AS (SELECT *, generate_subscripts(found, 1) AS k, unnest(found) AS hit, unnest(secrets) AS secret, unnest(gaps[1:len(found)]) AS gap FROM matched WHERE len(found) > 0),
placed AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY k) AS stop FROM each
),
spans AS (SELECT doc_id, source, rank, kind, (stop - length(hit))::INT AS start, stop::INT AS stop, sha256(secret) AS secret FROM placed WHERE length(secret) >= least),
owners AS (SELECT secret, count(DISTINCT coalesce(source, chr(0))) >= 3 AS copied FROM spans GROUP BY secret),
per_doc AS (
  SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
    count(*) FILTER (WHERE rank >= 3) AS n_further, count(*) FILTER (WHERE copied) AS n_copied, count(*) FILTER (WHERE NOT copied) AS n_own
  FROM spans JOIN owners USING (secret) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_further, 0) AS n_further,
  coalesce(n_copied, 0) AS n_copied, coalesce(n_own, 0) AS n_own
FROM documents d LEFT JOIN per_doc USING (doc_id)
"""


# A chain of replies is one path, so its formatted form follows from the turns alone.
CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, {escaped_role} AS role_out, {escaped_text} AS text_out FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role_out) + 1 + length(text_out) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _chat_sql() -> str:
    def escaped(column: str) -> str:
        for plain, mark in chat.ESCAPES:
            column = f"replace({column}, '{plain}', '{mark}')"
        return column

    role = f"replace({escaped('role')}, chr(10), '~n')"
    return CHAT_SQL.format(escaped_role=role, escaped_text=escaped("text"))


# Containment in the whole document, of every template.
LICENSES_SQL = r"""
WITH templates AS (SELECT * FROM (VALUES {templates}) t(template, text)),
cut AS (
  SELECT *, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w
  FROM (SELECT template AS id, text FROM templates UNION ALL SELECT doc_id::VARCHAR, text FROM documents)
),
shingles AS (
  SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM cut)
),
wanted AS (SELECT s.id AS template, s FROM shingles s JOIN templates t ON t.template = s.id),
shared AS (
  SELECT d.id, w.template, count(*) / (SELECT count(*) FROM wanted x WHERE x.template = w.template)::DOUBLE AS containment
  FROM wanted w JOIN shingles d ON d.s = w.s AND d.id NOT IN (SELECT template FROM templates) GROUP BY d.id, w.template
),
found AS (
  SELECT id, count(*)::INT AS n, string_agg(template, ',' ORDER BY template) AS names, min(containment) AS least FROM shared WHERE containment >= 0.8 GROUP BY id
)
SELECT doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(least, 0.0) AS least_containment
FROM documents LEFT JOIN found ON id = doc_id::VARCHAR
"""


def _licenses_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    return LICENSES_SQL.format(templates=", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.TEMPLATES.items()))


LM_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS w3, generate_subscripts(w, 1) AS i, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents)
),
grams AS (
  SELECT *, lag(w3, 1) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
),
c1 AS (SELECT w3, count(*) AS c FROM grams GROUP BY w3),
c2 AS (SELECT w2, w3, count(*) AS c FROM grams WHERE i > 1 GROUP BY w2, w3),
c3 AS (SELECT w1, w2, w3, count(*) AS c FROM grams WHERE i > 2 GROUP BY w1, w2, w3),
o1 AS (SELECT doc_id, w3, count(*) AS c FROM grams GROUP BY doc_id, w3),
o2 AS (SELECT doc_id, w2, w3, count(*) AS c FROM grams WHERE i > 1 GROUP BY doc_id, w2, w3),
o3 AS (SELECT doc_id, w1, w2, w3, count(*) AS c FROM grams WHERE i > 2 GROUP BY doc_id, w1, w2, w3),
seen AS (
  SELECT g.doc_id, g.i, g.n, (SELECT count(*) FROM words) AS total, c1.c - o1.c AS uni, p1.c - q1.c AS before, c2.c - o2.c AS bi, p2.c - q2.c AS pair, c3.c - o3.c AS tri
  FROM grams g JOIN c1 USING (w3) JOIN o1 USING (doc_id, w3)
  LEFT JOIN c1 p1 ON p1.w3 = g.w2 LEFT JOIN o1 q1 ON q1.doc_id = g.doc_id AND q1.w3 = g.w2
  LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3 LEFT JOIN o2 ON o2.doc_id = g.doc_id AND o2.w2 = g.w2 AND o2.w3 = g.w3
  LEFT JOIN c2 p2 ON p2.w2 = g.w1 AND p2.w3 = g.w2 LEFT JOIN o2 q2 ON q2.doc_id = g.doc_id AND q2.w2 = g.w1 AND q2.w3 = g.w2
  LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3
  LEFT JOIN o3 ON o3.doc_id = g.doc_id AND o3.w1 = g.w1 AND o3.w2 = g.w2 AND o3.w3 = g.w3
),
logs AS (
  SELECT doc_id, n, ln(CASE
    WHEN i > 2 AND tri > 0 THEN tri / pair::DOUBLE
    WHEN i > 1 AND bi > 0 THEN (CASE WHEN i > 2 THEN 0.4 ELSE 1 END)::DOUBLE * bi / before
    ELSE (CASE WHEN i > 2 THEN 0.16 WHEN i > 1 THEN 0.4 ELSE 1 END)::DOUBLE * greatest(uni, 1) / greatest(total - n, 1) END) AS l
  FROM seen
),
sums AS (SELECT doc_id, max(n) AS n_words, sum(l) AS s FROM logs GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / n_words, 4) AS mean_log_score
FROM documents LEFT JOIN sums USING (doc_id)
"""

# Every document is scored for every item.
RANKING_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
),
scored AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

QUERIES: dict[str, Query] = {
    "op1_licenses": op1_licenses,
    "op2_lm_scores": op2_lm_scores,
    "op3_secrets": op3_secrets,
    "op4_near_vectors": op4_near_vectors,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_chat_format": op6_chat_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_mix_sources": op9_mix_sources,
    "op10_decontaminate": op10_decontaminate,
    "op11_ranked_search": op11_ranked_search,
    "op12_toxicity": op12_toxicity,
    "op13_token_alignment": op13_token_alignment,
}
SQL: dict[str, str] = {
    "op1_licenses": _licenses_sql(),
    "op2_lm_scores": LM_SQL,
    "op3_secrets": _secrets_sql(),
    "op6_chat_format": _chat_sql(),
    "op7_line_dedup": "WITH " + LINES_SQL.format(documents="documents") + " SELECT * FROM deduped",
    "op11_ranked_search": RANKING_SQL,
    "op9_mix_sources": "WITH " + MIX_SQL.format(sizes=SIZES_SQL.format(documents="documents"))
    + " SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM mixed",
}
