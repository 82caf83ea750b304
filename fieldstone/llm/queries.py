"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldstone.llm.bitplanes import op9_token_files
from fieldstone.llm.decontamination import op1_decontamination
from fieldstone.llm.language_model import op5_language_model
from fieldstone.llm.line_dedup import op3_line_dedup
from fieldstone.llm.mixing import op6_mixing
from fieldstone.llm.pii import op10_pii
from fieldstone.llm.quality import op4_quality
from fieldstone.llm.simhash import op8_simhash
from fieldstone.llm.token_counts import op7_token_counts
from fieldstone.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_language_model": op5_language_model,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_simhash": op8_simhash,
    "op9_token_files": op9_token_files,
    "op10_pii": op10_pii,
}


def _columns(name: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """An operator's query cut to columns that SQL can check."""
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).selectExpr(*columns)


QUERIES |= {
    "quality_base": _columns("op4_quality", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
    "language_model_base": _columns("op5_language_model", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "round(base_score, 4) AS base_score"),
    "mixing_targets": _columns("op6_mixing", "doc_id", "size", "source_size", "round(target, 4) AS target"),
    "pii_counts": _columns("op10_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
}

#: crc32 of a document's id as text: each byte is taken in, then eight steps of the polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"


def _quota_rounds(rounds: int) -> str:
    """CTEs q0, q1, ...: each caps the sources whose share of what is left is above three times their words."""
    out = ["q0 AS (SELECT source, words, weight, NULL::DOUBLE AS capped, 0::DOUBLE AS share FROM weighed)"]
    for k in range(rounds):
        share = "weight * (sum(words) OVER () - coalesce(sum(capped) OVER (), 0)) / sum(CASE WHEN capped IS NULL THEN weight END) OVER ()"
        out.append(f"q{k + 1} AS (SELECT source, words, weight, CASE WHEN capped IS NULL AND share > 3 * words THEN 3 * words ELSE capped END AS capped, share FROM (SELECT source, words, weight, capped, {share} AS share FROM q{k}))")
    return ",\n".join(out)

#: Hashes by XXH64, learnt models and the tokenizer library have no SQL; those
#: columns are tested against brute force, exact round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM win),
gram AS (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc), sizes WHERE i + k - 1 <= len(w)),
found AS (SELECT doc_id, i, k, item_id FROM gram JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id),
often AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM doc) GROUP BY term),
need AS (SELECT item_id, ts, arg_min(term, coalesce(n, 0)) AS rare FROM (SELECT DISTINCT item_id, list_sort(list_distinct(g)) AS ts, unnest(list_distinct(g)) AS term FROM win) LEFT JOIN often USING (term) GROUP BY item_id, ts),
place AS (SELECT doc_id, i, w[i] AS rare, w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc) SEMI JOIN need ON need.rare = w[i]),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM place JOIN need USING (rare)
  WHERE list_has_all(list_slice(w, greatest(1, i - 19), i + 19), ts) AND len(list_filter(range(greatest(1, i - 19), i + 1), lambda s: list_has_all(list_slice(w, s, s + 19), ts))) > 0 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
""",
    "op3_line_dedup": r"""
WITH line AS (SELECT doc_id, i - 1 AS pos, l[i] AS line, list_filter(regexp_split_to_array(l[i], '[\x20\x09-\x0D]+'), lambda t: t <> '') AS raw
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(translate(text, concat(chr(9), chr(11), chr(12), chr(13)), '    '), chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
cell AS (SELECT doc_id, pos, line, tok, len(tok) AS n, array_to_string(list_slice(tok, 1, 4), ' ') AS head
  FROM (SELECT doc_id, pos, line, list_transform(raw, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tok FROM line) WHERE len(tok) > 0),
leaf AS (SELECT n, head FROM cell GROUP BY n, head HAVING count(DISTINCT doc_id) >= 4),
live AS (SELECT * FROM cell JOIN leaf USING (n, head)),
pick AS (SELECT n, head, i, count(DISTINCT t) AS kinds FROM (SELECT n, head, unnest(range(1, len(tok) + 1)) AS i, unnest(tok) AS t FROM live) GROUP BY n, head, i HAVING i > 4 AND kinds > 8),
wide AS (SELECT n, head, list(i) AS v FROM pick GROUP BY n, head),
formed AS (SELECT doc_id, pos, line, n, head, list_transform(range(1, len(tok) + 1), lambda i: CASE WHEN list_contains(coalesce(v, []), i) THEN '<*>' ELSE tok[i] END) AS form FROM live LEFT JOIN wide USING (n, head)),
shaped AS (SELECT doc_id, pos, n, head, CASE WHEN len(list_filter(form, lambda t: t <> '<*>')) * 100 >= 60 * n THEN 'template ' || array_to_string(form, ' ') ELSE 'line ' || line END AS shape FROM formed),
again AS (SELECT n, head, shape FROM shaped GROUP BY n, head, shape HAVING count(DISTINCT doc_id) >= 4),
gone AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM shaped JOIN again USING (n, head, shape) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM documents LEFT JOIN gone USING (doc_id)
""",
    "quality_base": r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc)),
again AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN again USING (doc_id, g)) GROUP BY doc_id),
line AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM doc JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)
""",
    "language_model_base": r"""
WITH doc AS (SELECT doc_id, CRC % 7 = 2 AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w FROM documents),
tok AS (SELECT doc_id, held_out, unnest(w) AS t FROM doc),
cnt AS (SELECT t, count(*) AS c FROM tok WHERE NOT held_out GROUP BY t),
tot AS (SELECT sum(c) AS n, count(*) AS v FROM cnt)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 1.0::DOUBLE) / (n + v + 1))), 4) AS base_score
FROM tok LEFT JOIN cnt USING (t), tot GROUP BY doc_id, held_out
""".replace("CRC", _CRC),
    "mixing_targets": r"""
WITH doc AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
weighed AS (SELECT source, sum(size)::DOUBLE AS words, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM doc GROUP BY source),
ROUNDS
SELECT doc_id, size, words::BIGINT AS source_size, round(coalesce(capped, share), 4) AS target
FROM doc JOIN q6 ON doc.source IS NOT DISTINCT FROM q6.source
""".replace("ROUNDS", _quota_rounds(6)),
    "pii_counts": r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
  regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda v: regexp_replace(v, '[^0-9]', '', 'g')) AS card,
  list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda v: len(regexp_replace(v, '[^0-9]', '', 'g'))) AS phone FROM doc)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda v: list_bool_and(list_transform(string_split(v, '.'), lambda x: len(ltrim(x, '0')) < 4 AND coalesce(TRY_CAST(x AS HUGEINT), 0) <= 255))))::BIGINT AS n_ip,
  len(list_filter(card, lambda d: len(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(len(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[len(d) - i]::INT ELSE d[len(d) - i]::INT * 2 - CASE WHEN d[len(d) - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda n: n BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM found
""",
}
