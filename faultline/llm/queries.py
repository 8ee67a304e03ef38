"""The registered queries of the numbered operators, and SQL for those whose whole result SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm.collocations import op12_collocations
from faultline.llm.decontamination import op6_decontamination
from faultline.llm.filter_audit import op13_filter_audit
from faultline.llm.language_id import op8_language_id
from faultline.llm.minmax_dedup import op11_minmax_dedup
from faultline.llm.ngram_join import op4_ngram_join
from faultline.llm.packing import op9_packing
from faultline.llm.personal_data import op5_personal_data
from faultline.llm.quality_classifier import op10_quality_classifier
from faultline.llm.quality_rules import op3_quality_rules
from faultline.llm.token_counts import op2_token_counts
from faultline.llm.token_files import op7_token_files
from faultline.llm.warc import op1_warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_warc,
        op2_token_counts,
        op3_quality_rules,
        op4_ngram_join,
        op5_personal_data,
        op6_decontamination,
        op7_token_files,
        op8_language_id,
        op9_packing,
        op10_quality_classifier,
        op11_minmax_dedup,
        op12_collocations,
        op13_filter_audit,
    )
}

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        equal AS (SELECT payload, max(page_id) AS winner, count(*) AS n FROM payloads GROUP BY payload),
        joined AS (
            SELECT page_id, payload, winner,
                   strlen(payload) >= 1000 AND n > 1 AND winner IS NOT NULL AND page_id IS DISTINCT FROM winner AS revisits
            FROM payloads JOIN equal USING (payload)
        )
        SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest,
               CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisits THEN winner END AS refers_to
        FROM joined
    """,
    "op4_ngram_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
        ),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)
        ),
        reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ),
        classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a)
        SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM classes
    """,
    "op6_decontamination": r"""
        WITH texts AS (
            SELECT doc_id AS id, false AS is_item, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark
        ),
        words AS (
            SELECT id, is_item, [x FOR x IN string_split_regex(
                regexp_replace(lower(coalesce(text, '')), '[!-/:-@\[-`{-~]', ' ', 'g'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM texts
        ),
        shingles AS (
            SELECT DISTINCT id, is_item, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM words
        ),
        sizes AS (SELECT id AS item_id, count(*) AS n_item FROM shingles WHERE is_item GROUP BY id),
        shared AS (
            SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
            FROM shingles d JOIN shingles i USING (s) WHERE NOT d.is_item AND i.is_item GROUP BY 1, 2
        )
        SELECT doc_id, item_id, n_shared::INTEGER AS n_shared, n_item::INTEGER AS n_item,
               n_shared::DOUBLE / n_item::DOUBLE AS containment
        FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_item
    """,
    "op11_minmax_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
            FROM shingles x JOIN shingles y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2
        ),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ),
        reach(a, b) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ),
        components AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM components LEFT JOIN sizes USING (doc_id)
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        words AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
        grams AS (
            SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS phrase
            FROM words, (SELECT unnest([1, 2, 3]) AS m)
        ),
        f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY 1, 2, 3),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
        inside AS (
            SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM candidates WHERE m = 3
        ),
        longer AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY 1, 2),
        alone AS (
            SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE m = 3 OR longest IS NULL OR 100 * longest < 50 * a
        ),
        cuts AS (
            SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest
            FROM alone, (SELECT unnest([1, 2]) AS k) WHERE k < m
        ),
        measured AS (
            SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
                   ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = first JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
        ),
        lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM measured),
        ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
            FROM lowest WHERE cut = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ),
        marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        least AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
        failing AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (len(w) < 100)::INT
                   + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                   + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * coalesce(texts.doc_id > first, false)::INT AS fails
            FROM texts JOIN least USING (t) LEFT JOIN marks ON marks.doc_id = texts.doc_id
        ),
        cells AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY 1, 2
        ),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ),
        steps AS (
            SELECT filter_order, s::INT AS step, bits[s] AS bit, list_sum(bits[:s - 1])::INT AS b4
            FROM orders, (SELECT unnest(range(1, 6)) AS s)
        ),
        seen AS (SELECT filter_order, step, bit, coalesce(b4, 0) AS b4 FROM steps),
        measured AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN fails & (b4 | bit) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN fails & b4 = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN fails & b4 > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN fails & b4 = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN fails & b4 = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM cells, seen GROUP BY 1, 2, 3, 4
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM measured
    """,
}
