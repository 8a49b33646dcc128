"""DuckDB SQL of the registered queries, written from the semantics and not from the Spark plans."""

from __future__ import annotations

import re

from strandweave.functions.text import WARNING_REASONS
from strandweave.plans.catalogue import FILES, NAMES, WARNING_TEXTS


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(values: tuple[str, ...]) -> str:
    return "(VALUES " + ", ".join(f"({_text(v)})" for v in values) + ")"


_GT = """CASE WHEN g < 4 AND sample_idx = 3 THEN '0|1|1' WHEN g < 10 THEN '0|1' WHEN g < 20 THEN '1|0' WHEN g < 26 THEN '1|1' WHEN g < 32 THEN '0|0' WHEN g = 32 THEN '.|.' WHEN g = 33 THEN '.'
 WHEN g = 34 THEN '0|9' WHEN g = 35 THEN '-1|0' WHEN g = 36 THEN 'ABC' WHEN g = 37 THEN '0|' WHEN g = 38 THEN '0/1' ELSE '1/0' END"""

#: Named views; a query takes those it needs, in this order.
_VIEWS = {
    "ref": """SELECT 'chr' || n_nationkey AS contig, CAST(n_nationkey AS INT) AS contig_ord,
 string_agg(translate(md5(n_nationkey || ':' || i), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS seq
 FROM nation, range(512) t(i) GROUP BY n_nationkey""",
    "placed": """SELECT CAST(o_orderkey AS BIGINT) AS k, 'chr' || (o_orderkey % 25) AS contig, (o_orderkey * 7919) % 16384 AS x,
 CASE WHEN o_orderkey % 1009 = 0 THEN 4200 + o_orderkey % 7 WHEN o_orderkey % 7 = 0 THEN 2 + o_orderkey % 5 ELSE 1 END AS reflen FROM orders""",
    "based": """SELECT p.*, CAST(CASE WHEN k % 101 = 0 THEN 16384 WHEN k % 103 = 0 THEN 16390 ELSE 1 + x - x % 32 + x % 3 END AS BIGINT) AS pos FROM placed p""",
    "spelled": """SELECT b.k, b.contig, b.pos, coalesce(substr(r.seq, b.pos, b.reflen), '') AS rb FROM based b LEFT JOIN ref r ON r.contig = b.contig""",
    "rec": """SELECT contig, k, pos, row_number() OVER (PARTITION BY contig ORDER BY pos, k) AS rec_ord,
 CASE WHEN rb = '' THEN 'A' WHEN k % 101 = 0 THEN rb || 'A' WHEN k % 97 = 0 THEN translate(rb, 'ACGT', 'CGTA') WHEN k % 89 = 0 THEN 'X' WHEN k % 83 = 0 THEN '.' ELSE rb END AS ref_,
 CASE k % 23 WHEN 0 THEN '<DEL>' WHEN 1 THEN '.' WHEN 2 THEN 'X' WHEN 3 THEN 'A,<INS>' WHEN 4 THEN 'A,,C' WHEN 5 THEN rb || 'GG' ELSE translate(substr(rb, 1, 1), 'ACGT', 'GTAC') END AS alt
 FROM spelled""",
    "fields": f"""SELECT contig, rec_ord, pos, ref_, alt, sample_idx, 'S' || sample_idx AS sample, gt || ':' || (k % 60) AS field, gt FROM
 (SELECT *, {_GT} AS gt FROM (SELECT r.*, j AS sample_idx, (k * 31 + j * 17) % 40 AS g FROM rec r, range(4) s(j)))""",
    "gts": """SELECT *, regexp_matches(gt, '^([+-]?[0-9]+|\\.)([/|]([+-]?[0-9]+|\\.))*$') AS valid, regexp_split_to_array(gt, '[/|]') AS tokens,
 1 + length(regexp_replace(gt, '[^/|]', '', 'g')) AS ploidy FROM fields WHERE ref_ <> '.'""",
    "checked": """SELECT c.*, pos - 1 AS start_, pos - 1 + length(ref_) AS end_,
 CASE WHEN ref_ = '.' THEN 'malformed_record' WHEN pos - 1 >= 16384 THEN 'pos_out_of_range' WHEN alt <> '.' AND list_contains(string_split(alt, ','), '') THEN 'empty_alt'
 WHEN NOT regexp_matches(ref_, '^[ACGTNacgtn]+$') THEN 'invalid_ref' WHEN pos - 1 + length(ref_) > 16384 THEN 'ref_interval_overflow'
 WHEN upper(ref_) <> upper(substr(r.seq, c.pos, length(ref_))) THEN 'ref_mismatch' END AS reason,
 CASE WHEN alt = '.' THEN [ref_] ELSE list_concat([ref_], string_split(alt, ',')) END AS alleles
 FROM rec c JOIN ref r ON r.contig = c.contig""",
    "cand": "SELECT contig, rec_ord, k, start_, end_, alleles, pos, ref_, alt FROM checked WHERE reason IS NULL",
    "picked": """SELECT contig, min(rec_ord) AS rec_ord, arg_min(end_, rec_ord) AS cursor_ FROM cand GROUP BY contig
 UNION ALL
 SELECT p.contig, min(c.rec_ord), arg_min(c.end_, c.rec_ord) FROM picked p JOIN cand c ON c.contig = p.contig AND c.rec_ord > p.rec_ord AND c.start_ >= p.cursor_ GROUP BY p.contig""",
    "applied": "SELECT c.* FROM cand c JOIN picked p ON p.contig = c.contig AND p.rec_ord = c.rec_ord",
    "ploidies": """SELECT contig, sample_idx, sample, coalesce(max(ploidy) FILTER (valid), 2) AS max_ploidy,
 coalesce(min(ploidy) FILTER (valid), 2) <> coalesce(max(ploidy) FILTER (valid), 2) AS variable,
 count(*) FILTER (contains(gt, '|')) AS phased, count(*) FILTER (contains(gt, '/') AND NOT contains(gt, '|')) AS unphased
 FROM gts GROUP BY contig, sample_idx, sample""",
    "haps": "SELECT contig, sample_idx, sample, max_ploidy, h AS hap FROM ploidies, range(8) t(h) WHERE h < max_ploidy",
    "coded": """SELECT contig, rec_ord, start_, end_, sample_idx, sample, hap, alleles,
 CASE WHEN NOT valid OR tok IS NULL THEN -1 WHEN tok = '.' OR a < 0 OR a >= len(alleles) THEN -2
 WHEN NOT regexp_matches(alleles[a + 1], '^[ACGTNacgtn]+$') THEN -2 ELSE a END AS code
 FROM (SELECT a.contig, a.rec_ord, a.start_, a.end_, a.alleles, h.sample_idx, h.sample, h.hap, g.valid,
 g.tokens[h.hap + 1] AS tok, TRY_CAST(g.tokens[h.hap + 1] AS INT) AS a
 FROM cand a JOIN gts g ON g.contig = a.contig AND g.rec_ord = a.rec_ord JOIN haps h ON h.contig = g.contig AND h.sample_idx = g.sample_idx)""",
    "called": "SELECT c.*, CASE WHEN code >= 0 THEN alleles[code + 1] END AS allele FROM coded c JOIN picked p ON p.contig = c.contig AND p.rec_ord = c.rec_ord",
    "gaps": """SELECT contig, rec_ord AS ord, coalesce(lag(end_) OVER (PARTITION BY contig ORDER BY start_), 0) AS gap_start, start_ AS gap_end FROM applied
 UNION ALL SELECT r.contig, coalesce(max(a.rec_ord), 0) + 1, coalesce(max(a.end_), 0), 16384 FROM ref r LEFT JOIN applied a ON a.contig = r.contig GROUP BY r.contig""",
    "segs": """SELECT g.contig, h.sample_idx, h.sample, h.hap, g.ord, substr(r.seq, g.gap_start + 1, g.gap_end - g.gap_start) AS gap,
 CASE c.code WHEN -2 THEN 'N' WHEN -1 THEN substr(r.seq, c.start_ + 1, 1) ELSE coalesce(c.allele, '') END AS text
 FROM gaps g JOIN ref r ON r.contig = g.contig JOIN haps h ON h.contig = g.contig
 LEFT JOIN called c ON c.contig = g.contig AND c.rec_ord = g.ord AND c.sample_idx = h.sample_idx AND c.hap = h.hap""",
    "seqs": "SELECT contig, sample_idx, sample, hap, string_agg(gap || text, '' ORDER BY ord) AS seq FROM segs GROUP BY ALL",
    "profile": """SELECT p.contig, v.variants, count(*) AS n_samples, CAST(sum(max_ploidy) AS BIGINT) AS haplotypes, CAST(max(max_ploidy) AS BIGINT) AS max_ploidy,
 CAST(sum(phased) AS BIGINT) AS phased, CAST(sum(unphased) AS BIGINT) AS unphased, bool_or(variable) AS variable, bool_and(max_ploidy = 2) AS diploid
 FROM ploidies p JOIN (SELECT contig, count(*) AS variants FROM rec WHERE ref_ <> '.' GROUP BY contig) v ON v.contig = p.contig GROUP BY p.contig, v.variants""",
    "warned": """SELECT contig, rec_ord, CAST(NULL AS BIGINT) AS sample_idx, reason FROM checked WHERE reason IS NOT NULL
 UNION ALL SELECT c.contig, c.rec_ord, NULL, 'overlap' FROM cand c WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.contig = c.contig AND p.rec_ord = c.rec_ord)
 UNION ALL SELECT g.contig, g.rec_ord, g.sample_idx, 'malformed_gt' FROM cand c JOIN gts g ON g.contig = c.contig AND g.rec_ord = c.rec_ord WHERE NOT g.valid
 UNION ALL SELECT contig, rec_ord, sample_idx, reason FROM (SELECT contig, rec_ord, sample_idx,
 CASE WHEN tok = '.' THEN 'missing_allele' WHEN CAST(tok AS INT) < 0 THEN 'negative_allele' WHEN CAST(tok AS INT) >= len(alleles) THEN 'invalid_allele_index'
 WHEN NOT regexp_matches(alleles[CAST(tok AS INT) + 1], '^[ACGTNacgtn]+$') THEN 'invalid_allele_index' END AS reason
 FROM (SELECT g.contig, g.rec_ord, g.sample_idx, c.alleles, unnest(g.tokens) AS tok FROM cand c JOIN gts g ON g.contig = c.contig AND g.rec_ord = c.rec_ord WHERE g.valid)) WHERE reason IS NOT NULL""",
    "runs": """SELECT sample, contig, min(pos) AS start_pos, max(pos) AS end_pos, CAST(ploidy AS BIGINT) AS ploidy, count(*) AS n FROM
 (SELECT *, sum(change) OVER (PARTITION BY contig, sample ORDER BY rec_ord) AS run FROM
 (SELECT *, CASE WHEN lag(ploidy) OVER (PARTITION BY contig, sample ORDER BY rec_ord) <> ploidy THEN 1 ELSE 0 END AS change FROM gts WHERE valid)) GROUP BY sample, contig, run, ploidy""",
    "named": "SELECT contig FROM ref WHERE contig_ord < 20 UNION ALL SELECT 'un' || contig_ord FROM ref WHERE contig_ord < 3",
    "files": f"SELECT path, regexp_extract(path, '[^/]*$') AS name FROM {_values(FILES)} f(path)",
}

_LADDER = "CASE " + " ".join(f"WHEN contains(message, {_text(p)}) THEN {_text(r)}" for p, r in WARNING_REASONS) + " ELSE 'other' END"

_FINAL = {
    "vcf_parse_records": "SELECT contig, rec_ord, pos, CASE WHEN k % 3 = 0 THEN 'rs' || k ELSE '.' END AS id, ref_ AS ref, alt, CAST(k % 100 AS VARCHAR) AS qual, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'q10' END AS filter, 'K=' || k AS info, CAST(4 AS BIGINT) AS n_samples, CASE WHEN ref_ = '.' THEN 'malformed_record' ELSE '' END AS malformed FROM rec",
    "gt_extract": "SELECT contig, rec_ord, sample_idx, string_split(field, ':')[1] AS gt FROM fields",
    "gt_parse_alleles": """SELECT contig, rec_ord, sample_idx, CASE WHEN regexp_matches(gt, '^([+-]?[0-9]+|\\.)([/|]([+-]?[0-9]+|\\.))*$')
 THEN array_to_string(list_transform(regexp_split_to_array(gt, '[/|]'), lambda t: CASE WHEN t = '.' OR t LIKE '-%' THEN '.' ELSE t END), ',') ELSE 'malformed' END AS alleles FROM fields""",
    "gt_phased_flag": """SELECT contig, rec_ord, sample_idx, CASE WHEN NOT regexp_matches(gt, '^([+-]?[0-9]+|\\.)([/|]([+-]?[0-9]+|\\.))*$') THEN 'malformed'
 WHEN NOT regexp_matches(gt, '[/|]') OR regexp_full_match(gt, '(\\.|-[0-9]+)([/|](\\.|-[0-9]+))*') OR NOT contains(gt, '/') THEN 'true' ELSE 'false' END AS phased FROM fields""",
    "gt_ploidy": "SELECT contig, rec_ord, sample_idx, CAST(CASE WHEN gt = '' THEN 0 ELSE 1 + length(regexp_replace(gt, '[^/|]', '', 'g')) END AS BIGINT) AS ploidy FROM fields",
    "allele_validity": """SELECT contig, rec_ord, i, a = '' OR a = '*' OR regexp_matches(a, '[<>\\[\\]]') AS symbolic, regexp_matches(a, '^[ACGTNacgtn]+$') AS nucleotides
 FROM (SELECT contig, rec_ord, unnest(string_split(alt, ',')) AS a, CAST(generate_subscripts(string_split(alt, ','), 1) - 1 AS BIGINT) AS i FROM rec)""",
    "variant_class": """SELECT contig, CASE WHEN length(ref_) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1 OR a = '.')) = 0 THEN 'snv' ELSE 'indel' END AS kind, count(*) AS n FROM rec GROUP BY ALL""",
    "contig_intersect": "SELECT contig FROM named INTERSECT SELECT contig FROM ref INTERSECT SELECT contig FROM rec",
    "contig_dropped": "SELECT contig FROM named EXCEPT (SELECT contig FROM ref INTERSECT SELECT contig FROM rec)",
    "ref_check": "SELECT contig, rec_ord, start_ AS start, end_ AS \"end\", coalesce(reason, 'valid') AS reason FROM checked",
    "reject_reasons": "SELECT coalesce(contig, 'all') AS contig, reason, count(*) AS n FROM warned WHERE sample_idx IS NULL GROUP BY ROLLUP (reason, contig) HAVING reason IS NOT NULL",
    "nonoverlap_select": "SELECT contig, rec_ord, start_ AS start, end_ AS \"end\" FROM applied",
    "contig_stats": """SELECT contig, count(*) FILTER (ref_ <> '.') AS seen, (SELECT count(*) FROM picked p WHERE p.contig = c.contig) AS applied FROM checked c GROUP BY contig""",
    "run_totals": """SELECT coalesce(s.contig, 'all') AS contig, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(applied) AS BIGINT) AS applied, CAST(sum(files) AS BIGINT) AS files FROM
 (SELECT contig, count(*) FILTER (ref_ <> '.') AS seen, (SELECT count(*) FROM picked p WHERE p.contig = c.contig) AS applied FROM checked c GROUP BY contig) s
 JOIN (SELECT contig, sum(max_ploidy) AS files FROM ploidies GROUP BY contig) f ON f.contig = s.contig GROUP BY ROLLUP (s.contig)""",
    "sample_ploidy": "SELECT contig, sample_idx, CAST(max_ploidy AS BIGINT) AS max_ploidy, variable, phased, unphased FROM ploidies",
    "contig_profile": "SELECT contig, variants, haplotypes, max_ploidy, phased, unphased, variable FROM profile",
    "workload_profile": """SELECT v.variants, v.malformed, v.snv, v.indel, p.haplotypes, p.phased, p.unphased FROM
 (SELECT count(*) FILTER (ref_ <> '.') AS variants, count(*) FILTER (ref_ = '.') AS malformed, count(*) FILTER (ref_ <> '.' AND kind = 'snv') AS snv, count(*) FILTER (ref_ <> '.' AND kind = 'indel') AS indel FROM
 (SELECT ref_, CASE WHEN length(ref_) = 1 AND len(list_filter(string_split(alt, ','), lambda a: length(a) <> 1 OR a = '.')) = 0 THEN 'snv' ELSE 'indel' END AS kind FROM rec)) v,
 (SELECT CAST(sum(m) AS BIGINT) AS haplotypes, CAST(sum(ph) AS BIGINT) AS phased, CAST(sum(un) AS BIGINT) AS unphased FROM
 (SELECT max(ploidy) AS m, count(*) FILTER (contains(gt, '|')) AS ph, count(*) FILTER (contains(gt, '/') AND NOT contains(gt, '|')) AS un FROM gts GROUP BY sample_idx)) p""",
    "legacy_route": """WITH parts AS (SELECT 'whole' AS part, 4 AS n, * FROM gts UNION ALL SELECT 'diploid', 3, * FROM gts WHERE sample_idx < 3 AND regexp_matches(gt, '^[01]/[01]$')
 UNION ALL SELECT 'one', 1, * FROM gts WHERE sample_idx = 0 UNION ALL SELECT 'phased', 4, * FROM gts WHERE gt = '0|1'),
 each AS (SELECT part, n, sample_idx, coalesce(max(ploidy) FILTER (valid), 2) AS top, coalesce(min(ploidy) FILTER (valid), 2) AS low, count(*) FILTER (contains(gt, '/')) AS unphased FROM parts GROUP BY ALL)
 SELECT part, CASE WHEN sum(unphased) = 0 THEN 'none' WHEN n = 1 THEN 'canonical' WHEN bool_or(top <> low) THEN 'variable-ploidy' WHEN bool_and(top = 2) THEN 'beagle' ELSE 'whatshap' END AS backend FROM each GROUP BY part, n""",
    "file_ploidy": "SELECT sample_idx, CAST(coalesce(max(ploidy) FILTER (valid), 2) AS BIGINT) AS max_ploidy FROM gts GROUP BY sample_idx",
    "global_haplotypes": "SELECT contig, CAST(row_number() OVER (PARTITION BY contig ORDER BY sample_idx, hap) - 1 AS BIGINT) AS global_hap, sample_idx, hap FROM haps",
    "run_slice": "SELECT contig, rec_ord, pos, field FROM fields WHERE contig = 'chr3' AND sample_idx = 3 AND pos BETWEEN 2000 AND 12000",
    "group_merge": """WITH own AS (SELECT contig, pos, ref_ AS ref, alt, sample, gt FROM gts WHERE contig = 'chr3' AND CASE WHEN sample = 'S3' THEN pos % 3 <> 1 ELSE pos % 3 <> 0 END)
 SELECT s.contig, s.pos, s.ref, s.alt, t.sample, coalesce(min(o.gt), './.') AS gt FROM (SELECT DISTINCT contig, pos, ref, alt FROM own) s CROSS JOIN (SELECT DISTINCT sample FROM own) t
 LEFT JOIN own o ON o.contig = s.contig AND o.pos = s.pos AND o.ref = s.ref AND o.alt = s.alt AND o.sample = t.sample GROUP BY ALL""",
    "ploidy_intervals": "SELECT DISTINCT contig, pos, CAST(CASE WHEN pos <= 5000 THEN 2 WHEN pos <= 9000 THEN 3 WHEN pos <= 15000 THEN 4 END AS BIGINT) AS ploidy FROM rec",
    "prefilter_counts": """SELECT count(*) FILTER (ref_ <> '.' AND contig_ord < 20 AND reason IS NULL) AS kept, count(*) FILTER (ref_ <> '.' AND contig_ord >= 20) AS dropped_contig,
 count(*) FILTER (ref_ = '.' OR (contig_ord < 20 AND reason IS NOT NULL)) AS dropped_invalid FROM checked c JOIN ref r ON r.contig = c.contig""",
    "warning_log": """WITH every AS (SELECT w.*, r.contig_ord FROM warned w JOIN ref r ON r.contig = w.contig)
 SELECT 'WARNING [' || contig || ':' || rec_ord || ']' || CASE WHEN sample_idx IS NULL THEN '' ELSE ' sample ' || sample_idx END || ' ' || reason AS value
 FROM (SELECT *, row_number() OVER (ORDER BY contig_ord, rec_ord, coalesce(sample_idx, -1), reason) AS nth FROM every) WHERE nth <= 500
 UNION ALL SELECT '# warnings log reached 500 lines; further warnings suppressed' FROM every HAVING count(*) > 500""",
    "run_log": """WITH seen AS (SELECT contig, count(*) FILTER (ref_ <> '.') AS seen, (SELECT count(*) FROM picked p WHERE p.contig = c.contig) AS applied FROM checked c GROUP BY contig),
 done AS (SELECT s.*, p.haplotypes, p.variants, CASE WHEN unphased = 0 OR max_ploidy <= 1 THEN 'none' WHEN n_samples = 1 THEN 'canonical' WHEN variable THEN 'variable-ploidy' WHEN diploid THEN 'beagle' ELSE 'whatshap' END AS backend
 FROM seen s JOIN profile p ON p.contig = s.contig)
 SELECT contig, 'DISCOVERY' AS tag, contig || ': ' || variants || ' records, ' || haplotypes || ' haplotypes' AS value FROM done
 UNION ALL SELECT contig, CASE WHEN backend IN ('none', 'canonical') THEN 'READY' ELSE 'PHASING' END, contig || ': ' || backend FROM done
 UNION ALL SELECT contig, 'COMPLETE', contig || ': ' || seen || ' seen, ' || applied || ' applied, ' || haplotypes || ' haplotypes' FROM done
 UNION ALL SELECT NULL, 'SUMMARY', count(*) || ' contigs, ' || sum(seen) || ' seen, ' || sum(applied) || ' applied, ' || sum(haplotypes) || ' haplotypes' FROM done""",
    "reference_slice": "SELECT contig, i * 3777 AS start, length(s) AS length, md5(s) AS md5 FROM (SELECT contig, i, substr(seq, i * 3777 + 1, 4500) AS s FROM ref, range(5) t(i))",
    "region_sequences": """WITH edge AS (SELECT * FROM applied WHERE contig = 'chr7'),
 parts AS (SELECT h.sample, h.hap, a.start_ AS spot, substr(r.seq, greatest(g.gap_start, 4000) + 1, a.start_ - greatest(g.gap_start, 4000)) ||
 CASE c.code WHEN -2 THEN 'N' WHEN -1 THEN substr(r.seq, c.start_ + 1, 1) ELSE c.allele END AS part
 FROM edge a JOIN gaps g ON g.contig = a.contig AND g.ord = a.rec_ord JOIN ref r ON r.contig = a.contig JOIN haps h ON h.contig = a.contig
 JOIN called c ON c.contig = a.contig AND c.rec_ord = a.rec_ord AND c.sample_idx = h.sample_idx AND c.hap = h.hap WHERE a.start_ >= 4000 AND a.start_ < 9000
 UNION ALL SELECT h.sample, h.hap, 9000, substr(r.seq, t.last + 1, greatest(0, 9000 - t.last)) FROM haps h JOIN ref r ON r.contig = h.contig,
 (SELECT greatest(4000, coalesce(max(end_), 0)) AS last FROM edge WHERE start_ < 9000) t WHERE h.contig = 'chr7')
 SELECT 'chr7' AS contig, sample, hap, length(seq) AS length, md5(seq) AS md5 FROM (SELECT sample, hap, string_agg(part, '' ORDER BY spot) AS seq FROM parts GROUP BY ALL)""",
    "truth_haplotypes": """WITH edits AS (SELECT c.*, row_number() OVER w AS nth, coalesce(lag(end_) OVER w, 0) AS before FROM called c WHERE code > 0 WINDOW w AS (PARTITION BY contig, sample_idx, hap ORDER BY start_)),
 parts AS (SELECT e.contig, e.sample, e.hap, e.start_ AS spot, substr(r.seq, before + 1, start_ - before) || allele AS part FROM edits e JOIN ref r ON r.contig = e.contig
 UNION ALL SELECT h.contig, h.sample, h.hap, 16385, substr(any_value(r.seq), coalesce(max(e.end_), 0) + 1) FROM haps h JOIN ref r ON r.contig = h.contig
 LEFT JOIN edits e ON e.contig = h.contig AND e.sample_idx = h.sample_idx AND e.hap = h.hap GROUP BY h.contig, h.sample, h.hap)
 SELECT contig, sample, hap, length(seq) AS length, md5(seq) AS md5 FROM (SELECT contig, sample, hap, string_agg(part, '' ORDER BY spot) AS seq FROM parts GROUP BY ALL)""",
    "length_attribution": """SELECT contig, sample_idx, hap, rec_ord, delta FROM (SELECT *, CASE WHEN code >= 0 THEN length(allele) ELSE 1 END - (end_ - start_) AS delta FROM called) WHERE delta <> 0""",
    "unexplained_lengths": "SELECT contig, sample_idx, hap, CAST(0 AS BIGINT) AS length, CAST(0 AS BIGINT) AS expected FROM haps WHERE false",
    "phase_route": """SELECT contig, backend, backend NOT IN ('none', 'canonical') AS needs_phasing FROM
 (SELECT contig, CASE WHEN unphased = 0 OR max_ploidy <= 1 THEN 'none' WHEN n_samples = 1 THEN 'canonical' WHEN variable THEN 'variable-ploidy' WHEN diploid THEN 'beagle' ELSE 'whatshap' END AS backend FROM profile)""",
    "any_unphased": "SELECT bool_or(contains(gt, '/')) AS any_unphased FROM gts",
    "variable_ploidy_exists": "SELECT bool_or(variable) AS variable FROM ploidies",
    "hap_offsets": """SELECT contig, sample_idx, CAST(coalesce(sum(max_ploidy) OVER (PARTITION BY contig ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hap_offset,
 CAST(sum(max_ploidy) OVER (PARTITION BY contig) AS BIGINT) AS haplotypes FROM ploidies""",
    "ploidy_groups": "SELECT contig, CAST(max_ploidy AS BIGINT) AS ploidy, string_agg(sample, ',' ORDER BY sample) AS samples FROM ploidies GROUP BY contig, max_ploidy",
    "ploidy_runs": "SELECT sample, contig, start_pos, end_pos, ploidy, n FROM runs",
    "ploidy_runs_eligible": "SELECT sample, contig, start_pos, end_pos, ploidy, n FROM runs WHERE start_pos <> end_pos AND ploidy >= 2",
    "run_merge": """SELECT g.contig, g.rec_ord, g.sample, CASE WHEN row_number() OVER (PARTITION BY g.contig, g.pos, g.sample ORDER BY g.rec_ord) = 1 THEN coalesce(p.gt, g.gt) ELSE g.gt END AS gt
 FROM gts g LEFT JOIN (SELECT contig, pos, sample, arg_max(translate(gt, '/', '|'), rec_ord) AS gt FROM gts WHERE rec_ord % 3 = 0 GROUP BY ALL) p
 ON p.contig = g.contig AND p.pos = g.pos AND p.sample = g.sample""",
    "sample_subset": "SELECT contig, rec_ord, string_agg(field, chr(9) ORDER BY sample_idx DESC) || chr(9) || '.' AS columns FROM fields WHERE sample_idx IN (0, 2) GROUP BY contig, rec_ord",
    "region_scan": "SELECT contig, rec_ord, pos, ref_ AS ref FROM rec WHERE contig = 'chr7' AND pos - 1 < 9000 AND pos - 1 + length(ref_) > 4000",
    "clean_gt": """SELECT c.contig, c.rec_ord, concat_ws(chr(9), c.contig, c.pos, CASE WHEN k % 3 = 0 THEN 'rs' || k ELSE '.' END, c.ref_, c.alt, k % 100, CASE WHEN k % 2 = 0 THEN 'PASS' ELSE 'q10' END, 'K=' || k, 'GT', string_agg(
 CASE WHEN NOT g.valid THEN array_to_string(list_transform(range(p.top), lambda i: '0'), '|')
 ELSE array_to_string(list_transform(g.tokens, lambda t: CASE WHEN t = '.' OR t LIKE '-%' OR CAST(t AS INT) >= len(c.alleles) THEN '.' ELSE t END), '|') END, chr(9) ORDER BY g.sample_idx)) AS line
 FROM cand c JOIN gts g ON g.contig = c.contig AND g.rec_ord = c.rec_ord JOIN (SELECT sample_idx, coalesce(max(ploidy) FILTER (valid), 2) AS top FROM gts GROUP BY sample_idx) p ON p.sample_idx = g.sample_idx
 GROUP BY c.contig, c.rec_ord, c.pos, c.ref_, c.alt, c.k""",
    "sample_warnings": "SELECT contig, sample_idx, reason, count(*) AS n FROM warned WHERE sample_idx IS NOT NULL GROUP BY ALL",
    "first_warnings": """SELECT contig, count(*) AS stored, min(rec_ord) AS first_rec, max(rec_ord) AS last_rec FROM
 (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY rec_ord, sample_idx NULLS FIRST, reason) AS nth FROM warned) WHERE nth <= 100 GROUP BY contig""",
    "single_sample_canonical": """SELECT contig, rec_ord, hap, CASE WHEN swap THEN CASE hap WHEN 0 THEN c1 ELSE c0 END ELSE code END AS code FROM
 (SELECT c.contig, c.rec_ord, c.hap, CAST(c.code AS BIGINT) AS code, CAST(o.c0 AS BIGINT) AS c0, CAST(o.c1 AS BIGINT) AS c1,
 c.hap < 2 AND len(g.tokens) = 2 AND g.valid AND contains(g.gt, '/') AND o.c0 >= 0 AND o.c1 >= 0 AND o.c0 > o.c1 AS swap
 FROM called c JOIN gts g ON g.contig = c.contig AND g.rec_ord = c.rec_ord AND g.sample_idx = c.sample_idx
 JOIN (SELECT contig, rec_ord, max(code) FILTER (hap = 0) AS c0, max(code) FILTER (hap = 1) AS c1 FROM called WHERE sample_idx = 0 GROUP BY ALL) o ON o.contig = c.contig AND o.rec_ord = c.rec_ord
 WHERE c.sample_idx = 0)""",
    "haplotype_calls": "SELECT contig, sample_idx, hap, CAST(code AS BIGINT) AS code, count(*) AS n FROM called GROUP BY ALL",
    "segments": "SELECT contig, sample_idx, hap, ord, length(gap) AS gap_length, text FROM segs",
    "hap_lengths": "SELECT contig, sample, hap, CAST(sum(length(gap) + length(text)) AS BIGINT) AS length FROM segs GROUP BY ALL",
    "segment_offsets": """SELECT contig, sample, hap, ord, CAST(coalesce(sum(length(gap) + length(text)) OVER (PARTITION BY contig, sample, hap ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at,
 length(gap) + length(text) AS length FROM segs""",
    "hap_sequences": "SELECT contig, sample, hap, length(seq) AS length, md5(seq) AS md5 FROM seqs",
    "fasta_lines": "SELECT sample || '_' || contig || ':' || hap AS name, i AS line, substr(seq, i * 80 + 1, 80) AS text FROM seqs, range(500) t(i) WHERE i * 80 < length(seq)",
    "merged_fasta": """WITH long AS (SELECT s.sample, s.hap, s.contig, s.seq, coalesce(sum(1 + ceil(length(s.seq) / 80.0)) OVER (PARTITION BY s.sample, s.hap ORDER BY r.contig_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
 FROM seqs s JOIN ref r ON r.contig = s.contig)
 SELECT sample, hap, CAST(head AS BIGINT) AS line, '>' || sample || '_' || contig || ':' || hap AS text FROM long
 UNION ALL SELECT sample, hap, CAST(head + 1 + i AS BIGINT), substr(seq, i * 80 + 1, 80) FROM long, range(500) t(i) WHERE i * 80 < length(seq)""",
    "chunk_plan": "SELECT contig, i * 5000 AS start, least(i * 5000 + 5000, 16384) AS \"end\" FROM ref, range(4) t(i)",
    "tile_plan": "SELECT contig, h * 3 AS hap_start, least(h * 3 + 3, 8) AS hap_end, i * 5000 AS base_start, least(i * 5000 + 5000, 16384) AS base_end FROM ref, range(4) t(i), range(3) u(h)",
    "chunk_pad": "SELECT CAST(greatest(2 * max(length(ref_)), 1000) AS BIGINT) AS pad FROM rec",
    "output_estimate": "SELECT contig, CAST((16384 + 205 + 64) * haplotypes AS BIGINT) AS output_bytes, CAST(variants * haplotypes + 16384 * haplotypes AS BIGINT) AS work_units FROM profile",
    "beagle_preflight": "SELECT contig, CAST(n_samples * variants * 64 AS BIGINT) AS need_bytes, n_samples * variants * 64 <= 75000 AS fits FROM profile",
    "file_pick_sample": """SELECT sample, path FROM (SELECT s.sample, f.path, row_number() OVER (PARTITION BY s.sample ORDER BY length(f.name), f.path) AS nth
 FROM (VALUES ('S1'), ('S2'), ('S3'), ('S10')) s(sample) JOIN files f ON starts_with(f.name, s.sample) AND regexp_matches(lower(f.name), '\\.(bam|cram)$')
 AND NOT regexp_matches(substr(f.name, length(s.sample) + 1, 1), '^[A-Za-z0-9]')) WHERE nth = 1""",
    "file_pick_chromosome": """SELECT c.contig, min(f.path) AS path FROM (VALUES ('chr1'), ('10'), ('chrX'), ('2'), ('chr3')) c(contig)
 JOIN files f ON regexp_matches(lower(f.name), '(^|[^a-z0-9])(chr|chrchr)?' || regexp_replace(lower(c.contig), '^chr', '') || '([^a-z0-9]|$)') GROUP BY c.contig""",
    "alignment_index": """SELECT path FROM files a WHERE regexp_matches(lower(name), '\\.(bam|cram)$') AND EXISTS (SELECT 1 FROM files i
 WHERE i.path IN (a.path || '.bai', a.path || '.csi', a.path || '.crai', regexp_replace(a.path, '\\.(bam|cram)$', '') || '.bai', regexp_replace(a.path, '\\.(bam|cram)$', '') || '.crai'))""",
    "warning_classify": f"SELECT message, {_LADDER} AS reason FROM {_values(WARNING_TEXTS)} w(message)",
    "name_sanitize": f"SELECT name, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') AS clean FROM {_values(NAMES)} n(name)",
    "sorted_check": """SELECT contig, rec_ord, pos, before AS previous_pos FROM (SELECT contig, rec_ord, pos, max(pos) OVER (PARTITION BY contig ORDER BY rec_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM
 (SELECT contig, pos, (CASE WHEN rec_ord % 50 = 0 THEN rec_ord - 3 ELSE rec_ord END) * 1000 + pos % 7 AS rec_ord FROM rec)) WHERE before > pos""",
    "source_variants": """SELECT contig, rec_ord, pos, ref_ AS ref, alt FROM (SELECT *, lag(pos) OVER (PARTITION BY contig ORDER BY rec_ord) AS before FROM rec
 WHERE NOT contains(alt, ',') AND regexp_matches(ref_, '^[ACGTNacgtn]+$') AND regexp_matches(alt, '^[ACGTNacgtn]+$')) WHERE before IS NULL OR pos > before""",
    "region_selection": "SELECT contig, CAST(max(pos + length(ref_) - 1) AS BIGINT) AS region_end FROM (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY rec_ord) AS nth FROM rec) WHERE nth <= 40 GROUP BY contig",
    "overlap_skips": "SELECT contig, rec_ord, pos FROM cand c WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.contig = c.contig AND p.rec_ord = c.rec_ord)",
    "length_differences": "SELECT contig, sample_idx, hap, CAST(sum(CASE WHEN code >= 0 THEN length(allele) ELSE 1 END - (end_ - start_)) AS BIGINT) AS delta FROM called GROUP BY ALL",
}


def _with(sql: str) -> str:
    """The query behind the views it needs, directly or through others."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in _VIEWS.items():
            if name not in need and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need.add(name)
                todo.append(body)
    views = ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in _VIEWS if n in need)
    if not views:
        return sql
    # a query's own WITH goes on behind the views
    return f"WITH RECURSIVE {views},\n{sql.removeprefix('WITH ')}" if sql.startswith("WITH ") else f"WITH RECURSIVE {views}\n{sql}"


ORACLES = {name: _with(sql) for name, sql in _FINAL.items()}
