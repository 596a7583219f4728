"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH sized AS (
    SELECT doc_id, source,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
    FROM documents
), sizes AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source IS NULL, source) AS rank
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
           3 * source_size AS bound
    FROM sizes
), levels AS (
    SELECT a.source, a.source_size, a.weight, a.bound, a.source_size / a.weight AS fullness,
           ((SELECT sum(source_size) FROM weighed)
            - coalesce((SELECT sum(b.bound) FROM weighed b
                        WHERE (b.source_size / b.weight, b.rank) < (a.source_size / a.weight, a.rank)), 0))::DOUBLE
           / (SELECT sum(b.weight) FROM weighed b
              WHERE (b.source_size / b.weight, b.rank) >= (a.source_size / a.weight, a.rank))::DOUBLE AS level,
           a.rank
    FROM weighed a
), chosen AS (
    SELECT arg_min(level, (fullness, rank)) AS level, min((fullness, rank)) AS since
    FROM levels WHERE level * weight <= bound
), targets AS (
    SELECT source, source_size,
           CASE WHEN (fullness, rank) >= chosen.since THEN least(chosen.level * weight, bound::DOUBLE)
                ELSE bound::DOUBLE END AS target
    FROM levels, chosen
), placed AS (
    SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS budget,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (budget // greatest(source_size, 1) * size
        + least(greatest(budget - budget // greatest(source_size, 1) * source_size - place, 0), size))::BIGINT AS taken
FROM placed
"""

OP12 = r"""
WITH worded AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
    FROM documents
), marks AS (
    SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), failing AS (
    SELECT part,
           (len(words) < 200)::INT
           + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
           + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text))::INT
           + 8 * regexp_matches(text, '[#$%&*|]')::INT
           + 16 * coalesce(doc_id > least, false)::INT AS fails,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM worded LEFT JOIN marks USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, fails
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
      AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step::INT AS step, l.letter, l.bit,
           coalesce((SELECT sum(m.bit) FROM letters m WHERE instr(filter_order, m.letter) < step), 0)::INT AS before
    FROM orders, range(1, 6) r(step), letters l WHERE l.letter = substr(filter_order, step, 1)
), audited AS (
    SELECT part, filter_order, step, letter,
           coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (fails & before > 0 AND fails & bit > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM audited
"""

SELECTS: dict[str, str] = {"op5_mix_sources": OP5, "op12_filter_audit": OP12}
