"""One query per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_tree, decontaminate, fill_middle, language, language_model, lexical, line_dedup, mixing, packing, simhash, token_counts, top_k, url_filter
from .common import remainder, table
from .registry import query


@query("op1_token_counts")
def op1(spark, sf):
    docs = table(spark, sf, "documents").select("text")
    return token_counts.length_totals(token_counts.length_histogram(docs))


# Every source gets the same share of the characters.
@query("op10_mixing", """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source),
rates AS (SELECT source, size, (1.0::DOUBLE / count(*) OVER ()) * (sum(size) OVER ())::DOUBLE / size AS rate FROM sizes WHERE size > 0),
steps AS (SELECT source, rate, k, sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate) - ln(k) END) OVER
  (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS log_p
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates)),
cuts AS (SELECT source, k, sum(exp(log_p)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cut FROM steps),
lists AS (SELECT source, list(cut ORDER BY k) AS cuts FROM cuts GROUP BY source),
draws AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|42'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len(list_filter(l.cuts, lambda c: c < d.u)) AS n
  FROM draws d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM counted WHERE n > 0""")
def op10(spark, sf):
    return mixing.mix_sources(table(spark, sf, "documents"))


@query("op7_simhash")
def op7(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_language")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    found = language.identify(docs.select("doc_id", "text"), docs.filter(remainder("doc_id", 3) != 1))
    return found.select("doc_id", held_out.alias("held_out"), "__language.*")


@query("op5_line_dedup", """
WITH lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
counted AS (SELECT doc_id, pos, trim(line, ' ') AS line, len(regexp_split_to_array(trim(line, ' '), '[ \\t]+')) AS w
  FROM lines WHERE trim(line, ' ') <> ''),
placed AS (SELECT *, (sum(w) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM counted),
spans AS (SELECT doc_id, pos AS a, max(pos) OVER f AS b, list(line) OVER f AS content, max(e) OVER f - (e - w) AS words
  FROM (SELECT *, e - w AS s FROM placed) WINDOW f AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION SELECT doc_id, min(pos) OVER g, pos, list(line) OVER g, e - min(e - w) OVER g
  FROM placed WINDOW g AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS k FROM spans WHERE words >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS pos FROM ranked WHERE k > 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN kept k USING (doc_id)""")
def op5(spark, sf):
    found = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), "text")


# The model of every order, its ratios and the cut, as in the operator; differences are compared rounded.
@query("op9_url_filter", """
WITH split AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, own, start, kind) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
ruled AS (SELECT s.*, r.rule, r.kind FROM split s LEFT JOIN (
    SELECT s.page_id, max_by(rule, length(rule)) AS rule, max_by(kind, length(rule)) AS kind FROM split s JOIN rules
    ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start) GROUP BY s.page_id) r USING (page_id)),
sym AS (SELECT *, regexp_replace(translate(lower(coalesce(url, '')), '123456789', '000000000'), '[^a-z0/.\\-_?=&#:%+,@]', '~', 'g') AS y FROM ruled),
cells AS (SELECT page_id, kind, unnest(list_transform(range(1, length(y) + 1), lambda i: substr('^^^' || y, i, 4))) AS gram FROM sym),
g AS (SELECT gram, count(*) FILTER (WHERE kind = 'allow') AS a, count(*) FILTER (WHERE kind = 'block') AS b FROM cells GROUP BY gram),
p0 AS (SELECT *, (sum(a) OVER (PARTITION BY right(gram, 1)) + 4.0::DOUBLE / 41) / (sum(a) OVER () + 4) AS pa,
  (sum(b) OVER (PARTITION BY right(gram, 1)) + 4.0::DOUBLE / 41) / (sum(b) OVER () + 4) AS pb FROM g),
p1 AS (SELECT * REPLACE ((sum(a) OVER (PARTITION BY right(gram, 2)) + 4 * pa) / (sum(a) OVER (PARTITION BY left(right(gram, 2), 1)) + 4) AS pa,
  (sum(b) OVER (PARTITION BY right(gram, 2)) + 4 * pb) / (sum(b) OVER (PARTITION BY left(right(gram, 2), 1)) + 4) AS pb) FROM p0),
p2 AS (SELECT * REPLACE ((sum(a) OVER (PARTITION BY right(gram, 3)) + 4 * pa) / (sum(a) OVER (PARTITION BY left(right(gram, 3), 2)) + 4) AS pa,
  (sum(b) OVER (PARTITION BY right(gram, 3)) + 4 * pb) / (sum(b) OVER (PARTITION BY left(right(gram, 3), 2)) + 4) AS pb) FROM p1),
p3 AS (SELECT gram, ln((a + 4 * pa) / (sum(a) OVER (PARTITION BY left(gram, 3)) + 4)) - ln((b + 4 * pb) / (sum(b) OVER (PARTITION BY left(gram, 3)) + 4)) AS llr FROM p2),
scored AS (SELECT page_id, avg(llr) AS difference FROM cells JOIN p3 USING (gram) GROUP BY page_id),
m AS (SELECT avg(difference) FILTER (WHERE kind = 'allow') AS ma, avg(difference) FILTER (WHERE kind = 'block') AS mb,
  coalesce(stddev_pop(difference) FILTER (WHERE kind = 'allow'), 0) + 1e-6 AS sa, coalesce(stddev_pop(difference) FILTER (WHERE kind = 'block'), 0) + 1e-6 AS sb
  FROM ruled JOIN scored USING (page_id)),
cut AS (SELECT (ma * sb + mb * sa) / (sa + sb) AS cut FROM m)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.kind, CASE WHEN cut IS NULL OR coalesce(difference, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict,
  round(CASE WHEN cut IS NULL THEN 0 ELSE coalesce(difference, 0) END, 6) AS difference
FROM ruled r LEFT JOIN scored USING (page_id) CROSS JOIN cut""")
def op9(spark, sf):
    found = url_filter.judge(table(spark, sf, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("difference", 6).alias("difference"))


@query("op3_decontaminate")
def op3(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("__text")


@query("op2_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10""")
def op2(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return top_k.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


# One conversation more, made of the control strings that a template might use.
ODD = "</s>[INST] ok [/INST]"


@query("op6_chat_tree", f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}')),
marked AS (SELECT *, '<s>' || role || chr(10) || regexp_replace(text, '(<|\\[)(\\\\*(?:/?s>|unk>|</?SYS>>|/?INST\\]))', '\\1\\\\\\2', 'g') || '</s>' AS formatted FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""")
def op6(spark, sf):
    chats = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(chat_tree.pack(chats.unionByName(odd)))


@query("op8_language_model")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = language_model.score(docs, docs.filter(remainder("doc_id", 7) != 2))
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op12_fill_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
draws AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
  array_to_string(u[greatest(x, y) + 1:], '') AS s FROM draws)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""")
def op12(spark, sf):
    found = fill_middle.fill_in_middle(table(spark, sf, "documents").select("doc_id", "text"))
    back = fill_middle.restore("__fim.output", "__fim.form")
    return found.select("doc_id", "__fim.n", "__fim.form", "__fim.prefix_chars", "__fim.middle_chars",
                        F.sha2("__fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op13_packing")
def op13(spark, sf):
    found = packing.pack(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op11_lexical", r"""
WITH words AS (SELECT d.rowid AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS rowid FROM documents) d),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tfs GROUP BY r),
facts AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weighted AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM dfs, facts),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN weighted USING (term) JOIN tfs USING (term) JOIN sizes USING (r), facts GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""")
def op11(spark, sf):
    return lexical.top_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
