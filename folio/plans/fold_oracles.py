"""Oracle SQL of queries whose rule is a fold or a graph: recursive views over a page's items in order."""

from __future__ import annotations

from folio.functions import text as T
from folio.plans.queries import _BANDS, _BOUNDS, _ITEM, _TERMS, ORACLES
from folio.sources.views import with_views


def _recursive(views: str) -> str:
    return views.replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES["translation_mock"] = """WITH t AS (SELECT conv_id || '.' || (turn // 2) AS segment_id, text FROM conversations WHERE role = 'user')
    SELECT segment_id, array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'the' THEN 'der' WHEN 'and' THEN 'und' ELSE w END), ' ') AS target, 'mock' AS provider, CAST(NULL AS VARCHAR) AS error FROM t"""

# A block is kept unless it repeats the kind and the first 80 characters of one of the last five that were kept.
ORACLES["structure_recent_repeats_dropped"] = f"""{_recursive(with_views("v_block"))}, b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, substring(text, 1, 80) AS k FROM v_block),
    r(page_id, n, recent, block_id) AS (SELECT page_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM (SELECT DISTINCT page_id FROM b)
        UNION ALL SELECT b.page_id, b.n, CASE WHEN again THEN recent ELSE list_slice(list_append(recent, key), -5, -1) END, CASE WHEN NOT again THEN b.block_id END
        FROM (SELECT r.*, b.* EXCLUDE (page_id, n, block_id), b.n AS m, b.block_id AS own, kind || chr(1) || k AS key, length(k) >= 3 AND list_contains(recent, kind || chr(1) || k) AS again FROM r JOIN b ON b.page_id = r.page_id AND b.n = r.n + 1) x JOIN b ON b.block_id = x.own)
    SELECT block_id FROM r WHERE block_id IS NOT NULL"""

# A sentence joins the current part unless the part would reach beyond 600 characters.
ORACLES["structure_split_paragraphs"] = f"""{_recursive(with_views("v_block"))}, b AS (SELECT page_id, block_id, CASE WHEN kind = 'paragraph' AND length(text) > 600 THEN string_split(regexp_replace(text, '(\\. )([A-ZА-ЯЁ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [text] END AS s FROM v_block),
    r(block_id, i, part, t) AS (SELECT block_id, 1, 0, s[1] FROM b
        UNION ALL SELECT b.block_id, i + 1, CASE WHEN length(t || s[i + 1]) - 1 <= 600 THEN part ELSE part + 1 END, CASE WHEN length(t || s[i + 1]) - 1 <= 600 THEN t || s[i + 1] ELSE s[i + 1] END FROM r JOIN b USING (block_id) WHERE i < len(s)),
    p AS (SELECT block_id, part, arg_max(t, i) AS t, max(part) OVER (PARTITION BY block_id) AS last FROM r GROUP BY block_id, part)
    SELECT page_id, CASE WHEN last > 0 THEN block_id || '.' || (part + 1) ELSE block_id END AS block_id, CAST(part AS INTEGER) AS part, trim(t) AS text FROM p JOIN b USING (block_id)"""

# A list item takes up the paragraphs that follow it, while they stand close below its growing box.
ORACLES["structure_list_continuations"] = f"""{_recursive(with_views("v_block"))}, {_ITEM}, b AS (SELECT page_id, block_id, pos, CASE WHEN pos % 4 = 0 THEN 'list_item' ELSE 'paragraph' END AS kind, text, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM i),
    r(page_id, n, block_id, pos, kind, text, x0, y0, x1, y1) AS (SELECT page_id, n, block_id, pos, kind, text, x0, y0, x1, y1 FROM b WHERE n = 1
        UNION ALL SELECT page_id, m, CASE WHEN j THEN block_id ELSE b_id END, CASE WHEN j THEN pos ELSE b_pos END, CASE WHEN j THEN kind ELSE b_kind END, CASE WHEN j THEN text || (CASE WHEN text = '' OR b_text = '' OR regexp_matches(text, '\\s$') THEN '' ELSE ' ' END) || b_text ELSE b_text END,
            CASE WHEN j THEN least(x0, bx0) ELSE bx0 END, CASE WHEN j THEN least(y0, by0) ELSE by0 END, CASE WHEN j THEN greatest(x1, bx1) ELSE bx1 END, CASE WHEN j THEN greatest(y1, by1) ELSE by1 END
        FROM (SELECT r.*, b.n AS m, b.block_id AS b_id, b.pos AS b_pos, b.kind AS b_kind, b.text AS b_text, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
            r.kind = 'list_item' AND b.kind = 'paragraph' AND b.y0 - r.y1 BETWEEN -5 AND 20 AND (length(trim(r.text)) <= 5 OR b.x0 >= r.x0 - 5) AS j FROM r JOIN b ON b.page_id = r.page_id AND b.n = r.n + 1))
    SELECT page_id, block_id, any_value(pos) AS pos, any_value(kind) AS kind, arg_max(text, n) AS text, arg_max(x0, n) AS x0, arg_max(y0, n) AS y0, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1 FROM r GROUP BY 1, 2"""

# Columns of bands: a run of empty bins of the middle third that is a gutter wide, with 15 percent of the items on either side.
_REGIONS = f"""{_ITEM}, {_BOUNDS}, {_BANDS}, bn AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY nth) AS band, (x0 + x1) / 2 AS cx, CAST(least(greatest(trunc((x0 + x1) / 2 * 20 / width), 0), 19) AS INTEGER) AS bin FROM al),
    bb AS (SELECT page_id, band, max(width) AS width, count(*) AS total, list(bin) AS bins FROM bn GROUP BY 1, 2),
    cand AS (SELECT page_id, band, width, total, bins, b, (SELECT min(e) FROM range(6, 15) t(e) WHERE e >= b AND (e = 14 OR list_contains(bins, e))) AS e FROM bb, range(6, 14) s(b) WHERE NOT list_contains(bins, b) AND (b = 6 OR list_contains(bins, b - 1))),
    gut AS (SELECT page_id, band, min(b) * max(width) / 20 AS gutter FROM cand WHERE total >= 2 AND (e - b) * width / 20 >= 10 AND 100 * len(list_filter(bins, lambda x: x < b)) >= 15 * total AND 100 * len(list_filter(bins, lambda x: x >= e)) >= 15 * total GROUP BY 1, 2),
    cl AS (SELECT bn.*, CASE WHEN gutter IS NULL OR cx < gutter THEN 1 ELSE 2 END AS col FROM bn LEFT JOIN gut USING (page_id, band)),
    grp AS (SELECT page_id, CASE place WHEN 'header' THEN 1 WHEN 'footer' THEN 2 ELSE 3 END AS a, CASE WHEN place = 'full_width' THEN y0 ELSE 0 END AS c, CASE WHEN place = 'full_width' THEN item_id ELSE '' END AS d, 0 AS bnd, place AS pk, * EXCLUDE (page_id, place, cy) FROM (SELECT *, 0 AS cy FROM pl) WHERE place <> 'content'
        UNION ALL SELECT page_id, 4, col, '', band, 'column', block_id, item_id, pos, kind, text, category, x0, y0, x1, y1, width FROM cl),
    g AS (SELECT page_id, a, bnd, c, d, any_value(pk) AS pk, any_value(category) AS cat, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, max(width) AS width, count(*) FILTER (category = 'text') AS nt, count(*) FILTER (category = 'image') AS ni, count(*) FILTER (category = 'table') AS nb, count(*) FILTER (category = 'vector') AS nv, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM grp GROUP BY 1, 2, 3, 4, 5),
    rg AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY a, bnd, c, d) AS INTEGER) AS ordinal,
        CASE WHEN a = 1 THEN 'header' WHEN a = 2 THEN 'footer' WHEN a = 3 THEN CASE cat WHEN 'table' THEN 'table_area' WHEN 'image' THEN 'figure_area' ELSE 'full_width' END
            WHEN nb > 0 AND 2 * nb >= n THEN 'table_area' WHEN ni > 0 AND 2 * ni >= n AND nt < 3 THEN 'figure_area' WHEN (x1 - x0) / width < 0.2 AND nt >= 1 AND (x0 <= 40 OR width - x1 <= 40) THEN 'margin_note'
            WHEN (x1 - x0) / width < 0.55 AND nt >= 1 AND ni + nv >= 1 THEN 'callout_area' WHEN (x1 - x0) / width < 0.35 AND nt >= 1 THEN 'sidebar' WHEN nt >= 1 THEN 'body' ELSE 'unknown' END AS kind,
        x0, y0, x1, y1, n, CASE WHEN a <= 2 THEN 0.9 WHEN a = 3 THEN 1.0 WHEN n >= 5 THEN 0.9 WHEN n >= 2 THEN 0.8 ELSE 0.7 END AS confidence, item_ids FROM g)"""

ORACLES["layout_regions"] = f"{with_views('v_block')}, {_REGIONS} SELECT page_id, ordinal, printf('r%03d', ordinal) AS region_id, kind, x0, y0, x1, y1, n, CAST(confidence AS DOUBLE) AS confidence, item_ids FROM rg"

# A main region joins the first band that covers half of its height, and the band grows; asides go to their nearest main region.
ORACLES["layout_reading_order"] = f"""{_recursive(with_views("v_block"))}, {_REGIONS}, ro AS (SELECT *, printf('r%03d', ordinal) AS region_id, CASE WHEN kind IN ('header', 'footer') THEN 'furniture' WHEN kind IN ('sidebar', 'margin_note', 'callout_area') THEN 'aside' ELSE 'main' END AS role FROM rg),
    mn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, ordinal) AS k FROM ro WHERE role = 'main'),
    f(page_id, k, bands, own) AS (SELECT page_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a DOUBLE, b DOUBLE)[]), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT page_id FROM mn)
        UNION ALL SELECT page_id, k + 1, CASE WHEN hit IS NULL THEN list_append(bands, {{'a': y0, 'b': y1}}) ELSE list_transform(bands, lambda x, j: CASE WHEN j = hit THEN {{'a': least(x.a, y0), 'b': greatest(x.b, y1)}} ELSE x END) END, coalesce(hit, len(bands) + 1)
        FROM (SELECT f.page_id, f.k, bands, y0, y1, nullif(list_position(list_transform(bands, lambda x: y1 > y0 AND (least(y1, x.b) - greatest(y0, x.a)) / (y1 - y0) >= 0.5), TRUE), 0) AS hit FROM f JOIN mn ON mn.page_id = f.page_id AND mn.k = f.k + 1)),
    fin AS (SELECT page_id, arg_max(bands, k) AS bands FROM f GROUP BY 1),
    bk AS (SELECT page_id, j AS own, row_number() OVER (PARTITION BY page_id ORDER BY y, j) AS band FROM (SELECT page_id, unnest(range(1, len(bands) + 1)) AS j, unnest(list_transform(bands, lambda x: x.a)) AS y FROM fin)),
    ml AS (SELECT mn.*, bk.band, row_number() OVER (PARTITION BY mn.page_id ORDER BY bk.band, x0, ordinal) AS position FROM mn JOIN f ON f.page_id = mn.page_id AND f.k = mn.k JOIN bk ON bk.page_id = f.page_id AND bk.own = f.own)
    SELECT page_id, region_id, role, CAST(band AS INTEGER) AS band, CAST(position AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS main_region FROM ml
    UNION ALL SELECT r.page_id, r.region_id, r.role, NULL, NULL, CASE WHEN r.role = 'aside' THEN (SELECT arg_min(m.region_id, (power(m.x0 + m.x1 - r.x0 - r.x1, 2) + power(m.y0 + m.y1 - r.y0 - r.y1, 2), m.ordinal)) FROM mn m WHERE m.page_id = r.page_id) END FROM ro r WHERE r.role <> 'main'"""

# Boxes that meet within four points are of one cluster, and so is what they lead to.
ORACLES["layout_vector_clusters"] = f"""{_recursive(with_views("v_block"))}, {_ITEM}, p AS (SELECT page_id, page_id || '/' || block_id AS node, x0, y0, x1, y1 FROM i),
    e AS (SELECT a.node AS s, b.node AS t FROM p a JOIN p b ON a.page_id = b.page_id AND a.node <> b.node AND a.x0 - 4 <= b.x1 AND b.x0 - 4 <= a.x1 AND a.y0 - 4 <= b.y1 AND b.y0 - 4 <= a.y1),
    r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t),
    c AS (SELECT s AS node, least(s, min(t)) AS cluster FROM r GROUP BY s)
    SELECT page_id, cluster, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n, substring(sha256(string_agg(node, ' ' ORDER BY node)), 1, 12) AS digest FROM c JOIN p USING (node) GROUP BY 1, 2"""

# Words with their places, character by character, against the terms.
ORACLES["glossary_term_matches"] = f"""{with_views("v_block")}, {_TERMS}, ch AS (SELECT page_id, block_id, unnest(range(length(text))) AS i, unnest(string_split(lower(text), '')) AS c FROM v_block),
    w AS (SELECT *, regexp_matches(c, '[\\p{{L}}\\p{{N}}_]') AS inside FROM ch), s AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER o, FALSE) THEN 1 ELSE 0 END AS new FROM w WINDOW o AS (PARTITION BY block_id ORDER BY i)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS nth FROM s),
    k AS (SELECT page_id, block_id, min(i) AS a, max(i) + 1 AS b, string_agg(c, '' ORDER BY i) AS word FROM g WHERE inside GROUP BY page_id, block_id, nth)
    SELECT page_id, block_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", 'c.' || form AS concept_id FROM k JOIN tm ON word = form"""

_STRIP = "text"
for _name, _pattern in T.DECORATIVE:
    _STRIP = f"regexp_replace({_STRIP}, '{_pattern}', '{' ' if _name == 'placeholder' else ''}', 'g')"
_DECORATED = " OR ".join(f"regexp_matches(text, '{p}')" for _, p in T.DECORATIVE)

# Decorative tokens go; a paragraph of over 1,000 characters is cut at the sentence boundary nearest to its middle.
ORACLES["patch_findings_fixed"] = f"""{with_views("v_defect")}, f AS (SELECT *, CASE WHEN {_DECORATED} THEN trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) ELSE text END AS clean, kind = 'paragraph' AND length(text) > 1000 AS long FROM v_defect),
    c AS (SELECT *, CASE WHEN long THEN (list_sort(list_transform(list_filter(range(2, length(clean) + 1), lambda i: regexp_matches(substring(clean, i - 1, 3), '^[.!?]\\s[A-ZА-ЯЁ]$')), lambda i: [abs(i - length(clean) / 2), i])))[1][2] END AS cut FROM f),
    n AS (SELECT page_id, pos, 0 AS o, {{'block_id': block_id, 'kind': kind, 'text': CASE WHEN cut IS NULL THEN clean ELSE rtrim(substring(clean, 1, CAST(cut AS BIGINT))) END}} AS b FROM c
        UNION ALL SELECT page_id, pos, 1, {{'block_id': block_id || '.1', 'kind': 'paragraph', 'text': ltrim(substring(clean, CAST(cut AS BIGINT) + 1))}} FROM c WHERE cut IS NOT NULL)
    SELECT page_id, CAST(to_json({{'blocks': list(b ORDER BY pos, o)}}) AS VARCHAR) AS doc, CAST(NULL AS VARCHAR) AS error FROM n GROUP BY 1"""
