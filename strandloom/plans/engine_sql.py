"""SQL that gives what the mapper gives: chains, banded alignments, the choice in scan order, SAM columns and calls.

Every step is written from its definition, cell by cell and pair by pair, with recursive queries in place of loops,
so that it shares no method with the operators. It is for small data.
"""

from __future__ import annotations

from ..functions.masks import Mask

#: Values that hold in the operators too: see chains, alignment and selection.
MATCH, GAP, BAND, SHARE = 2, 3, 20, 0.99
KEYS = "read_id, strand, ref_idx, w"


def chains(pairs: str, mask: Mask) -> str:
    """CTEs up to `chain` (a row for each run) and `block` (its blocks), from CTEs that end in `pairs` and have `r`, `g`, `d`."""
    full, gains = MATCH * mask.weight, "[" + ", ".join(str(MATCH * x) for x in mask.gains) + "]"
    follows = f"h[x] - v[x] = h[i + 1] - v[i + 1] OR v[x] + {mask.span} <= v[i + 1]"
    pays = f"sc[j] + CASE WHEN h[j] - v[j] <> h[i + 1] - v[i + 1] THEN {full} - {GAP} * abs((h[j] - v[j]) - (h[i + 1] - v[i + 1])) ELSE {gains}[least(v[i + 1] - v[j], {mask.span}) + 1] END"
    return f"""{pairs},
grp AS (SELECT {KEYS}, list(voff ORDER BY voff, hoff) v, list(CAST(hoff AS INT) ORDER BY voff, hoff) h, CAST(count(*) AS INT) n, any_value(d) d FROM pairs GROUP BY {KEYS} HAVING count(*) > 1 AND count(*) < any_value(d) // 6 * 5),
link AS (
  SELECT {KEYS}, d, v, h, n, 0 i, CAST([] AS INT[]) sc, CAST([] AS INT[][]) runs FROM grp
  UNION ALL
  SELECT {KEYS}, d, v, h, n, i + 1, list_append(sc, greatest(top, {full})),
    CASE WHEN top <= {full} THEN list_append(runs, [i + 1])
      WHEN runs[k][1] = js[k] THEN list_concat(runs[1:k - 1], [list_prepend(i + 1, runs[k])], runs[k + 1:])
      ELSE list_append(runs, list_prepend(i + 1, runs[k][list_position(runs[k], js[k]):])) END
  FROM (SELECT *, coalesce(list_max(gained), 0) top, list_position(gained, list_max(gained)) k FROM (
    SELECT *, [CASE WHEN j IS NOT NULL THEN {pays} END FOR j IN js] gained FROM (
      SELECT *, [list_filter(p, lambda x: {follows})[1] FOR p IN runs] js FROM link WHERE i < n)))),
done AS (SELECT *, list_max([sc[p[1]] FOR p IN runs]) top FROM link WHERE i = n),
kept AS (SELECT {KEYS}, d, v, h, top, [list_reverse(p) FOR p IN runs IF sc[p[1]] = top AND len(p) > 1] best FROM done WHERE top >= 10),
run AS (SELECT {KEYS}, d, v, h, top, best, unnest(CASE WHEN len(best) = 0 THEN [-1] ELSE range(len(best)) END) run FROM kept),
run2 AS (SELECT {KEYS}, CAST(run AS INT) run, d, top, v, h, CASE WHEN run >= 0 THEN best[run + 1] END p FROM run),
chain AS (SELECT {KEYS}, run, d, top chain_score, v[p[1]] v_start, h[p[1]] h_start, v[p[-1]] v_stop, h[p[-1]] h_stop,
    CASE WHEN h[p[1]] - v[p[1]] = h[p[-1]] - v[p[-1]] THEN 3 ELSE abs((h[p[1]] - v[p[1]]) - (h[p[-1]] - v[p[-1]])) + 5 END band,
    w * d + least(h[p[1]] - v[p[1]], h[p[-1]] - v[p[-1]]) - 1 a_start FROM run2),
pair AS (SELECT {KEYS}, run, unnest(range(1, len(p) + 1)) k, v[unnest(p)] v, h[unnest(p)] h FROM run2),
fresh AS (SELECT *, CASE WHEN h - v = lag(h - v) OVER (PARTITION BY {KEYS}, run ORDER BY k) THEN 0 ELSE 1 END f FROM pair),
number AS (SELECT *, sum(f) OVER (PARTITION BY {KEYS}, run ORDER BY k) b FROM fresh),
block AS (SELECT {KEYS}, run, b, arg_min(v, k) bv, arg_min(h, k) bh, CAST(arg_max(v, k) + {mask.span} - arg_min(v, k) AS INT) size FROM number GROUP BY {KEYS}, run, b),
blocks AS (SELECT {KEYS}, run, string_agg(bv || ':' || bh || ':' || size, ',' ORDER BY b) blocks FROM block GROUP BY {KEYS}, run)"""


def _filled(columns: str) -> str:
    """Columns with -1 for missing numbers."""
    return ", ".join(f"coalesce({c}, -1) {c}" for c in columns.split())


CHAIN_COLUMNS = f"""read_id, strand, ref_idx, w AS "window", run, chain_score, {_filled("v_start h_start v_stop h_stop")}, coalesce(blocks, '') blocks, CAST(coalesce(band, -1) AS INT) band, coalesce(a_start, -1) a_start"""


def candidates(pairs: str, mask: Mask, bisulfite: bool) -> str:
    """CTEs up to `cand`: chains with matches in their blocks and their alignment; `ablock` has its blocks."""

    def same(q: str, t: str) -> str:
        return f"({q} = {t} OR ({q} = 'T' AND {t} = 'C'))" if bisulfite else f"({q} = {t})"

    hit = same("substr(q, i + 1, 1)", "substr(t, i + p, 1)")
    here = same("substr(c.q, s.r + 1, 1)", "substr(c.t, s.r + s.p, 1)")
    dull = "" if bisulfite else " * CASE WHEN CAST(n_match AS FLOAT) < CAST(length(q) AS FLOAT) * CAST(0.9 AS FLOAT) OR CAST(n_mismatch + n_gap AS FLOAT) > (CAST(1 AS FLOAT) - CAST(0.9 AS FLOAT)) * CAST(n_match AS FLOAT) THEN 0 ELSE 1 END"
    return f"""{chains(pairs, mask)},
seq AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {KEYS}, run) id, {KEYS}, run, d, CAST(band AS INT) band, a_start,
    CASE WHEN strand = 1 THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END q,
    repeat('@', greatest(-a_start, 0)) || substr(g.seq, greatest(a_start, 0) + 1, length(r.seq) + band + least(a_start, 0)) t
  FROM chain JOIN r USING (read_id) JOIN g USING (ref_idx) WHERE run >= 0 AND band < {BAND}),
anchor AS (SELECT id, CAST(count(*) FILTER (WHERE {same("substr(q, v + 1, 1)", "substr(t, z + 1, 1)")}) AS INT) anchor_match, CAST(count(*) AS INT) n FROM (
  SELECT id, q, t, bv + k v, w * d - a_start + bh + k z FROM (SELECT *, unnest(range(size)) k FROM block JOIN seq USING ({KEYS}, run))) GROUP BY id),
cell AS (
  SELECT id, band, q, t, 0 i, [0 FOR p IN range(band)] row FROM seq
  UNION ALL
  SELECT id, band, q, t, i + 1, [list_max([own[x] - 3 * (p - x) FOR x IN range(1, p + 1)]) FOR p IN range(1, band + 1)] FROM (
    SELECT id, band, q, t, i, [greatest(row[p] + CASE WHEN {hit} THEN 1 ELSE -2 END, coalesce(row[p + 1], 0) - 3, 0) FOR p IN range(1, band + 1)] own FROM cell WHERE i < length(q))),
matrix AS MATERIALIZED (SELECT id, i, row FROM cell),
peak AS (SELECT id, i - 1 r, list_position(row, list_max(row)) p, list_max(row) top FROM matrix WHERE i > 0),
best AS (SELECT id, arg_max(r, (top, -r)) r, arg_max(p, (top, -r)) p, max(top) top FROM peak GROUP BY id),
trace AS (
  SELECT id, CAST(r AS INT) r, CAST(p AS INT) p, CAST(r AS INT) stop, true open, 0 n_match, 0 n_mismatch, 0 n_gap, CAST([] AS INT[][]) made, false fin FROM best WHERE top > 0
  UNION ALL
  SELECT id, CASE WHEN diag THEN r - 1 WHEN side THEN r ELSE r - 1 END, CASE WHEN diag THEN p WHEN side THEN p - 1 ELSE p + 1 END,
    CASE WHEN diag AND NOT open THEN r ELSE stop END, diag,
    n_match + CAST(diag AND eq AS INT), n_mismatch + CAST(diag AND NOT eq AS INT), n_gap + CAST(NOT diag AS INT),
    CASE WHEN diag AND up = 0 THEN list_prepend([r, r + p - 1, CASE WHEN open THEN stop ELSE r END - r + 1], made) WHEN NOT diag AND open THEN list_prepend([r + 1, r + p, stop - r], made) ELSE made END,
    diag AND up = 0
  FROM (SELECT *, up + CASE WHEN eq THEN 1 ELSE -2 END = here diag, coalesce(before, 0) - 3 = here side FROM (
    SELECT s.*, {here} eq, a.row[s.p] here, CASE WHEN s.p > 1 THEN a.row[s.p - 1] END before, b.row[s.p] up
    FROM trace s JOIN seq c USING (id) JOIN matrix a ON a.id = s.id AND a.i = s.r + 1 JOIN matrix b ON b.id = s.id AND b.i = s.r WHERE NOT s.fin))),
traced AS (SELECT id, n_match, n_mismatch, n_gap, made FROM trace WHERE fin),
aligned AS (SELECT {KEYS}, run, id, q, t, anchor_match, n - anchor_match anchor_mismatch, CAST(top{dull} AS INT) sw_score, n_match, n_mismatch, n_gap,
    made[1][1] av_start, CASE WHEN top > 0 THEN CAST(best.r AS INT) END av_stop, made[1][2] ah_start, CASE WHEN top > 0 THEN CAST(best.r + best.p - 1 AS INT) END ah_stop, made
  FROM seq JOIN anchor USING (id) JOIN best USING (id) LEFT JOIN traced USING (id)),
cand AS (SELECT chain.*, aligned.* EXCLUDE ({KEYS}, run) FROM chain LEFT JOIN aligned USING ({KEYS}, run)),
ablock AS (SELECT id, k, made[k][1] v, made[k][2] h, made[k][3] size FROM (SELECT id, made, unnest(range(1, len(made) + 1)) k FROM aligned)),
ablocks AS (SELECT id, string_agg(v || ':' || h || ':' || size, ',' ORDER BY k) ablocks FROM ablock GROUP BY id)"""


ALIGNMENT_COLUMNS = f"{CHAIN_COLUMNS}, {_filled('anchor_match anchor_mismatch sw_score n_match n_mismatch n_gap av_start av_stop ah_start ah_stop')}, coalesce(ablocks, '') ablocks"


def outcomes(pairs: str, mask: Mask, bisulfite: bool, most: int) -> str:
    """CTEs up to `outcome`: what becomes of each candidate of a read, in scan order."""
    return f"""{candidates(pairs, mask, bisulfite)},
inorder AS MATERIALIZED (SELECT cand.*, length(r.seq) size, row_number() OVER (PARTITION BY read_id ORDER BY ref_idx, w, strand, run) k FROM cand JOIN r USING (read_id)),
walk AS (
  SELECT read_id, CAST(0 AS BIGINT) k, 0 best_anchor, 0 best_skel, 0 best, 0 places, CAST(NULL AS BIGINT) on_ref, CAST(0 AS BIGINT) upto, CAST(NULL AS BIGINT) g_ref, CAST(NULL AS BIGINT) g_w, CAST(NULL AS INT) g_strand, false skip, 'none' what FROM (SELECT DISTINCT read_id FROM inorder)
  UNION ALL
  SELECT read_id, k, best_anchor, CASE WHEN what IN ('near', 'short', 'written') THEN greatest(best_skel, skel) ELSE best_skel END,
    CASE WHEN what IN ('short', 'written') THEN greatest(best, sw_score) ELSE best END,
    CASE WHEN what NOT IN ('short', 'written') THEN places WHEN sw_score > best THEN 1 WHEN sw_score = best THEN places + 1 ELSE places END,
    CASE WHEN what IN ('short', 'written') AND sw_score >= best THEN ref_idx ELSE on_ref END,
    CASE WHEN what IN ('short', 'written') AND sw_score >= best THEN w * d + h_stop + {mask.span} ELSE upto END,
    ref_idx, w, strand, skip, what
  FROM (SELECT *, CASE WHEN skip OR run < 0 OR sw_score IS NULL THEN 'passed' WHEN 4 * anchor_mismatch > anchor_match THEN 'poor' WHEN skel < best_skel * 7 // 10 THEN 'skeleton'
      WHEN sw_score < best * CAST({SHARE} AS DOUBLE) THEN CASE WHEN skel < best_skel * 9 // 10 THEN 'predicted' ELSE 'failed' END
      WHEN sw_score = best AND on_ref = ref_idx AND upto + size >= w * d + h_start + 1 THEN 'near' WHEN sw_score >= {mask.span} THEN 'written' ELSE 'short' END what
    FROM (SELECT x.* EXCLUDE (k), x.k, x.anchor_match - 3 * x.anchor_mismatch skel, y.best_skel, y.best, y.places, y.on_ref, y.upto,
        CASE WHEN y.g_ref = x.ref_idx AND y.g_w = x.w AND y.g_strand = x.strand THEN y.best_anchor WHEN x.chain_score < y.best_anchor * 3 // 4 THEN y.best_anchor ELSE greatest(y.best_anchor, x.chain_score) END best_anchor,
        CASE WHEN y.g_ref = x.ref_idx AND y.g_w = x.w AND y.g_strand = x.strand THEN y.skip ELSE x.chain_score < y.best_anchor * 3 // 4 OR (y.best >= x.size AND y.places > {most}) END skip
      FROM walk y JOIN inorder x ON x.read_id = y.read_id AND x.k = y.k + 1))),
outcome AS (SELECT inorder.*, what FROM inorder JOIN walk USING (read_id, k))"""


def mappings(pairs: str, mask: Mask, bisulfite: bool, most: int) -> str:
    """CTEs up to `mapping`: the alignments that stay."""
    return f"""{outcomes(pairs, mask, bisulfite, most)},
top AS (SELECT *, max(sw_score) OVER (PARTITION BY read_id) most FROM outcome WHERE what = 'written'),
few AS (SELECT *, count(*) OVER (PARTITION BY read_id) n FROM top WHERE sw_score >= most * CAST({SHARE} AS DOUBLE)),
mapping AS (SELECT * FROM few WHERE n <= {most})"""


def sam(pairs: str, mask: Mask, bisulfite: bool, most: int) -> str:
    """The whole query of SAM columns. Contig 2 k is the reverse complement of 2 k - 1 in a doubled reference."""
    name, flip, minus = ("'doc' || (ref_idx + 1) // 2", "ref_idx % 2 = 0", "ref_idx % 2 = 0") if bisulfite else ("'doc' || ref_idx", "false", "strand = 1")
    clip = lambda n: f"CASE WHEN {n} > 0 THEN {n} || 'S' ELSE '' END"
    return f"""WITH RECURSIVE {mappings(pairs, mask, bisulfite, most)},
gaps AS (SELECT *, v - lag(v + size) OVER (PARTITION BY id ORDER BY k) gv, h - lag(h + size) OVER (PARTITION BY id ORDER BY k) gh FROM ablock),
piece AS (SELECT *, CASE WHEN gv IS NULL THEN '' WHEN gv > gh THEN gv || 'I' ELSE gh || 'D' END gap, CASE WHEN gv IS NULL THEN 0 WHEN gv > gh THEN gv ELSE -gh END indel FROM gaps),
cigar AS (SELECT id, string_agg(gap || size || 'M', '' ORDER BY k) forth, string_agg(size || 'M' || gap, '' ORDER BY k DESC) back, CAST(sum(indel) AS BIGINT) indel, min(v) head, max(v + size) tail FROM piece GROUP BY id)
SELECT read_id, ref_idx, sw_score, 'item' || read_id qname, CASE WHEN {minus} THEN 16 ELSE 0 END flag, {name} rname,
  CAST(CASE WHEN {flip} THEN length(g.seq) - a_start - ah_start - (av_stop - av_start) + indel ELSE a_start + 1 + ah_start END AS INT) pos, 99 mapq,
  CASE WHEN {flip} THEN {clip("size - tail")} || back || {clip("head")} ELSE {clip("head")} || forth || {clip("size - tail")} END cigar,
  '*' rnext, 0 pnext, 0 tlen, CASE WHEN {minus} THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END seq, repeat('I', length(r.seq)) qual
FROM mapping JOIN cigar USING (id) JOIN r USING (read_id) JOIN g USING (ref_idx)"""


def calls(pairs: str, mask: Mask, bisulfite: bool, most: int) -> str:
    """The whole query of variant or methylation calls."""
    kinds = "WHEN c = 'C' AND b = 'C' THEN CASE WHEN n1 = 'G' THEN 'CG' WHEN n2 = 'G' THEN 'CHG' ELSE 'CHH' END WHEN c = 'C' AND b = 'T' THEN 'CONV' " if bisulfite else ""
    return f"""WITH RECURSIVE {mappings(pairs, mask, bisulfite, most)},
base AS (SELECT read_id, ref_idx, a_start + h + x pos, v + x read_pos, substr(q, v + x + 1, 1) b, substr(t, h + x + 1, 1) c, substr(t, h + x + 2, 1) n1, substr(t, h + x + 3, 1) n2
  FROM (SELECT m.*, a.v, a.h, CAST(unnest(range(a.size)) AS INT) x FROM mapping m JOIN ablock a USING (id)))
SELECT read_id, ref_idx, pos, read_pos, kind, b allele FROM (SELECT *, CASE {kinds}WHEN b <> c THEN 'SNP' END kind FROM base) WHERE kind IS NOT NULL"""


COUNTERS = """CAST(count(DISTINCT (read_id, strand, ref_idx, w)) AS BIGINT) anchorings, count(*) FILTER (what IN ('predicted', 'failed', 'near', 'short', 'written')) alignments,
count(*) FILTER (what IN ('predicted', 'failed')) failed_alignments, count(*) FILTER (what = 'poor') poor_anchorings, count(*) FILTER (what = 'predicted') predicted_by_skeleton, count(*) FILTER (what = 'skeleton') under_skeleton"""
