"""SQL twins of the corpus operators that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized) x),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM sized) k WHERE len(w) >= n) x),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
reach AS (SELECT doc_id, i AS p, max(i + n) AS stop FROM hits GROUP BY doc_id, i),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM hits)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT words.doc_id, words.p, max(stop) OVER (PARTITION BY words.doc_id ORDER BY words.p) AS stop FROM words LEFT JOIN reach ON words.doc_id = reach.doc_id AND words.p = reach.p) c WHERE stop > p GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listing FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listing, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hits AS (SELECT win.doc_id, win.i FROM win JOIN firsts ON win.h = firsts.h WHERE firsts.m < win.doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
seen AS (SELECT words.doc_id, p, word, max(hits.i) OVER (PARTITION BY words.doc_id ORDER BY p) AS last FROM words LEFT JOIN hits ON words.doc_id = hits.doc_id AND words.p = hits.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM seen WHERE last IS NULL OR p - last > 49 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _weights(level: str, weights: dict[str, dict[str, int]]) -> str:
    known = weights.get(level, {})
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in known.items() if k != "*")
    return f"CASE {level} {cases} ELSE {known.get('*', 1)} END" if cases else str(known.get("*", 1))


def mixing(share: float, epochs: int, weights: dict[str, dict[str, int]], seed: int) -> str:
    levels, parts, budget = ["domain", "lang", "source"], [], "total"
    for k, level in enumerate(levels):
        path, up = levels[: k + 1], levels[:k]
        join = f"JOIN {budget} ON " + " AND ".join(f"n{k}.{c} = {budget}.{c}" for c in up) if up else f"CROSS JOIN {budget}"
        over = f"PARTITION BY {', '.join(up)}" if up else ""
        parts += [
            f"n{k} AS (SELECT {', '.join(path)}, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap, {_weights(level, weights)} AS weight FROM leaves GROUP BY {', '.join(path)})",
            f"o{k} AS (SELECT {', '.join(f'n{k}.{c}' for c in path)}, cap, weight, budget FROM n{k} {join})",
            f"""q{k} AS (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / CAST(weight AS DOUBLE), {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(weight) OVER ({over} ORDER BY cap / CAST(weight AS DOUBLE), {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM o{k})""",
            f"f{k} AS (SELECT *, CAST(budget - before AS HUGEINT) * weight >= CAST(cap AS HUGEINT) * ahead AS full_up FROM q{k})",
            f"g{k} AS (SELECT *, sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({over}) AS kept, sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ({over}) AS open FROM f{k})",
            f"s{k} AS (SELECT {', '.join(path)}, CASE WHEN full_up THEN cap ELSE CAST((CAST(budget - kept AS HUGEINT) * weight) // open AS BIGINT) END AS budget FROM g{k})",
        ]
        budget = f"s{k}"
    return rf"""
WITH d AS (SELECT doc_id, 'domain' || (coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\d{{1,9}})$', 1) AS BIGINT), 0) % 4) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY domain, lang, source),
total AS (SELECT CAST(floor(sum(tokens) * {share}) AS BIGINT) AS budget FROM leaves),
{", ".join(parts)},
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - (CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END) * tokens AS rest
  FROM s2 JOIN leaves l ON s2.domain = l.domain AND s2.lang = l.lang AND s2.source = l.source),
keyed AS (SELECT d.*, whole, rest, md5('{seed}:' || (whole + 1) || ':' || doc_id) AS k FROM d JOIN plan ON d.domain = plan.domain AND d.lang = plan.lang AND d.source = plan.source),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS so_far FROM keyed)
SELECT doc_id, domain, lang, source, CAST(whole + CASE WHEN so_far < rest THEN 1 ELSE 0 END AS BIGINT) AS n_epochs FROM run WHERE whole > 0 OR so_far < rest
"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200) x),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM win SEMI JOIN twice ON win.h = twice.h),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM hits GROUP BY doc_id, island),
opens AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM opens),
runs AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM numbered GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 1) AS a, a AS z FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT gaps.doc_id, string_agg(hex(CASE WHEN z IS NULL THEN b[gaps.a:] WHEN z > gaps.a THEN b[gaps.a:z - 1] ELSE ''::BLOB END), '' ORDER BY gaps.a, z NULLS LAST) AS x FROM gaps JOIN d ON gaps.doc_id = d.doc_id GROUP BY gaps.doc_id),
counted AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(x), b)) AS kept_sha256
FROM d LEFT JOIN counted ON d.doc_id = counted.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: Base32 from the hex digits of a SHA-1: five hex digits are four letters.
WARC = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
letters AS (SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest FROM p),
last AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS response FROM letters)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < response THEN response END AS refers_to FROM last
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _tree(name: str, bottom: str, start: str, levels: int, branch: int) -> list[str]:
    """Tables of the levels over ``bottom (g, i, h, c)``, and of the rows of ``start (g, i, proof, f, ...)`` with proof and folded digest carried up by each."""
    parts = [f"{name}0 AS (SELECT g, i, h, c FROM {bottom})"]
    for k in range(levels):
        run = f"OVER (PARTITION BY g, i // {branch} ORDER BY i ROWS BETWEEN"
        parts += [
            f"""{name}s{k} AS (SELECT g, i, c, CASE WHEN c > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
              CASE WHEN c > 1 THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k})""",
            f"{name}{k + 1} AS (SELECT g, i // {branch} AS i, CASE WHEN c > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (c + {branch - 1}) // {branch} AS c FROM {name}{k} GROUP BY g, i // {branch}, c)",
            f"{name}f{k} AS (SELECT b.* EXCLUDE (proof, f), proof || l || r AS proof, CASE WHEN s.c > 1 THEN sha256(l || f || r) ELSE f END AS f FROM {f'{name}f{k - 1}' if k else start} b JOIN {name}s{k} s ON b.g = s.g AND b.i // {branch**k} = s.i)",
        ]
    return parts


def merkle(branch: int) -> str:
    """Eight levels below a language (16 million rows) and four above."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in (*[f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")], text)]
        return f"sha256({' || '.join(parts)})"

    step = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b))"
    crc = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: {step}, 4294967295), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS f FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS c, '' AS proof FROM d),
{", ".join(_tree("n", "leaves", "leaves", 8, branch))},
tops AS (SELECT '' AS g, g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c FROM n8),
below AS (SELECT tops.g, tops.i, doc_id, a.h AS leaf, tops.h AS subroot, proof, f FROM nf7 a JOIN tops ON a.g = tops.lang),
{", ".join(_tree("m", "tops", "below", 4, branch))}
SELECT doc_id, leaf, subroot, m4.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = m4.h AS verified FROM mf3 CROSS JOIN m4
"""
