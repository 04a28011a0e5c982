"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from quantloom.llm.decontam import TOKEN, UNITS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def recompression(window: int = 13) -> str:
    return f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {window - 2}, 1))) AS i FROM w)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM win JOIN least USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM gone) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def templates(window: int = 8, min_windows: int = 6) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    words = f" WHERE len(list_filter(ts[a + 1:a + {window}], lambda x: x NOT IN ('#n', '#u', '#p'))) > 0"

    def side(name: str, key: str, source: str) -> str:
        return rf"""{name}_t AS (SELECT {key}, unnest(t) AS raw, generate_subscripts(t, 1) AS i FROM (SELECT {key}, regexp_extract_all(text, '{TOKEN}') AS t FROM {source})),
{name}_p AS (SELECT *, lag(raw, 1, '.') OVER (PARTITION BY {key} ORDER BY i) AS prev FROM {name}_t),
{name}_m AS (SELECT {key}, i, raw, CASE WHEN raw IN ('.', '!', '?') THEN NULL WHEN regexp_matches(raw, '^\p{{Nd}}') THEN '#n' WHEN regexp_matches(prev, '^\p{{Nd}}') AND lower(raw) IN ({units}) THEN '#u' WHEN raw[1] <> lower(raw[1]) THEN '#p' ELSE lower(raw) END AS tmpl FROM {name}_p),
{name}_s AS (SELECT {key}, list(tmpl ORDER BY i) AS ts, list(lower(raw) ORDER BY i) AS raws FROM {name}_m WHERE tmpl IS NOT NULL GROUP BY {key}),
{name}_w AS (SELECT {key}, a, count(*) OVER (PARTITION BY {key}) AS n_all, array_to_string(ts[a + 1:a + {window}], ' ') AS k FROM (SELECT {key}, ts, unnest(range(0, greatest(len(ts) - {window - 1}, 1))) AS a FROM {name}_s){words if key == 'item_id' else ''})"""

    return f"""WITH {side('d', 'doc_id', 'documents')}, {side('b', 'item_id', 'benchmark')},
steps AS (SELECT doc_id, item_id, d_w.a - b_w.a AS shift, count(DISTINCT b_w.a) AS n_windows, any_value(b_w.n_all) AS n_all, min(b_w.a) AS lo, max(b_w.a) + {window - 1} AS hi FROM d_w JOIN b_w USING (k) GROUP BY ALL),
found AS (SELECT * FROM steps WHERE n_windows >= least({min_windows}, n_all)),
slot AS (SELECT doc_id, item_id, shift, n_windows, b_s.raws[p + 1] AS x, d_s.raws[p + shift + 1] AS y, b_s.ts[p + 1] AS tmpl FROM (SELECT *, unnest(range(lo, hi + 1)) AS p FROM found) JOIN b_s USING (item_id) JOIN d_s USING (doc_id)),
judged AS (SELECT doc_id, item_id, shift, n_windows, count(*) FILTER (WHERE tmpl IN ('#n', '#u', '#p')) AS n_slots, count(*) FILTER (WHERE tmpl IN ('#n', '#u', '#p') AND x IS DISTINCT FROM y) AS n_changed,
count(DISTINCT x) FILTER (WHERE tmpl IN ('#n', '#u', '#p')) = count(DISTINCT (x, y)) FILTER (WHERE tmpl IN ('#n', '#u', '#p')) AND count(DISTINCT y) FILTER (WHERE tmpl IN ('#n', '#u', '#p')) = count(DISTINCT (x, y)) FILTER (WHERE tmpl IN ('#n', '#u', '#p')) AS fits FROM slot GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_slots::INT AS n_slots, n_changed::INT AS n_changed FROM judged WHERE fits QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_windows DESC, n_changed, n_slots DESC) = 1"""


def mixing(entropy_share: float = 0.95, max_repeats: float = 4.0, blocks: int = 4096, seed: str = "mix") -> str:
    def measure(points: str) -> str:
        return f"SELECT e, ln(sum(w)) - sum(w * ln(w)) / sum(w) AS h, max(w / tokens) / sum(w) * any_value(total) AS r FROM (SELECT e, tokens, total, pow(tokens::DOUBLE / total, e) AS w FROM tot, ({points})) GROUP BY e"

    def search(name: str, test: str, best: str, none: str) -> str:
        """Three sections of the unit interval by hundredths, as fixed-point numbers in units of 1e-6."""
        out, lo = [], "0"
        for k, step in enumerate((10_000, 100, 1)):
            pts = f"SELECT unnest(range(0, 101)) * {step} + {lo} AS u"
            pick = f"coalesce({best}(CASE WHEN {test} THEN u END), {none.format(lo=lo, step=step)})"
            out.append(f"{name}{k} AS (SELECT {pick} AS u0 FROM (SELECT u, h, r FROM ({measure('SELECT DISTINCT u / 1e6 AS e FROM (' + pts + ')')}) JOIN ({pts}) ON e = u / 1e6))")
            back = step if best == "min" else 0
            lo = f"(SELECT least(greatest(u0 - {back}, 0), 1000000 - {step}) FROM {name}{k})"
        return ", ".join(out)

    key = lambda at: f"md5(concat('{seed}|', source, '|', CAST({at} AS VARCHAR), '|', CAST(block AS VARCHAR)))"
    doc_key = lambda at: f"md5(concat('{seed}|', CAST({at} AS VARCHAR), '|', CAST(doc_id AS VARCHAR)))"
    return f"""WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, len({_WORDS}) AS n_tokens, (CAST(concat('0x', substr(md5(concat('{seed}|', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) % {blocks})::INT AS block FROM documents),
bt AS (SELECT source, block, sum(n_tokens)::BIGINT AS bt FROM docs GROUP BY ALL), st AS (SELECT source, sum(bt)::BIGINT AS tokens FROM bt GROUP BY ALL HAVING sum(bt) > 0), tot AS (SELECT source, tokens, (SELECT sum(tokens)::BIGINT FROM st) AS total FROM st),
{search('en', f"h >= {entropy_share} * ln((SELECT count(*) FROM tot)) - 1e-12", 'max', '{lo}')}, {search('re', f"r <= {max_repeats} + 1e-12", 'min', '{lo} + 100 * {step}')},
al AS (SELECT greatest((SELECT u0 FROM en2), (SELECT u0 FROM re2)) / 1e6 AS a),
ws AS (SELECT source, tokens, pow(tokens::DOUBLE / total, a) AS w, total FROM tot, al), pl AS (SELECT source, tokens, floor(w / sum(w) OVER () * total + 1e-6)::BIGINT AS budget FROM ws),
plan AS (SELECT source, (budget // tokens)::INT AS passes, budget - budget // tokens * tokens AS rest FROM pl),
bb AS (SELECT source, block, passes, rest, coalesce(sum(bt) OVER (PARTITION BY source ORDER BY {key('passes')}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bt JOIN plan USING (source)),
run AS (SELECT docs.*, passes, rest, before + sum(n_tokens) OVER (PARTITION BY source, block ORDER BY {doc_key('passes')}, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM docs JOIN bb USING (source, block)),
tm AS (SELECT *, passes + CASE WHEN upto <= rest AND rest > 0 AND n_tokens > 0 THEN 1 ELSE 0 END AS times FROM run), taken AS (SELECT *, unnest(range(0, times))::INT AS pass FROM tm WHERE times > 0)
SELECT doc_id, source, n_tokens, pass, block, concat(substr({key('pass')}, 1, 12), substr({doc_key('pass')}, 1, 20)) AS order_key FROM taken"""
