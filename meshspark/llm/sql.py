"""SQL that gives the rows of those queries that SQL can express; DuckDB runs it on the same tables."""

from __future__ import annotations

from .quality import RULES as QUALITY_RULES
from .secrets import RULES as SECRET_RULES

WORDS = r"[^\x20\x09-\x0D]+"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets() -> str:
    """Spans from the matches and the pieces between them, one rule after the other."""
    each = " UNION ALL ".join(
        f"SELECT doc_id, {o} AS o, {_text(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {_text(r.pattern)}) AS m, regexp_extract_all(t, {_text(r.pattern)}, {r.group}) AS g, regexp_split_to_array(t, {_text(r.pattern)}) AS p FROM d"
        for o, r in enumerate(SECRET_RULES)
    )
    count = lambda kind: f"coalesce(count(*) FILTER (kind = '{kind}'), 0)::BIGINT AS n_{kind}"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({each}),
hits AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT doc_id, o, kind, least, length(m[i]) AS n, length(g[i]) AS gn,
  list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS begins FROM hits),
spans AS (SELECT doc_id, o, kind, begins::BIGINT AS s, (begins + n)::BIGINT AS e FROM placed WHERE gn >= least),
by_doc AS (SELECT doc_id, {count("assign")}, {count("access")}, {count("hex")}, {listed} FILTER (o < 3) AS base, {listed} AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc ON by_doc.doc_id IS NOT DISTINCT FROM d.doc_id"""


def near_dedup(percent: int = 85) -> str:
    """All pairs that share a shingle, counted; components by reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    after = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, 5))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d WHERE len(w) >= 5),
grams AS (SELECT doc_id, word, {after} FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
sets AS (SELECT DISTINCT doc_id, concat_ws(' ', word, w1, w2, w3, w4) AS s FROM grams WHERE w4 IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT s FROM sets GROUP BY s HAVING count(*) > 1),
common_sets AS (SELECT doc_id, s FROM sets SEMI JOIN shared USING (s)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM common_sets a JOIN common_sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * held >= {percent} * (x.n + y.n - held)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS seen FROM ways UNION SELECT r.id, w.b FROM reach r JOIN ways w ON w.a = r.seen),
roots AS (SELECT id, min(seen) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots ON id = d.doc_id"""


_BADNESS = {
    "short_words": "-word_chars / n_words",
    "long_words": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
}


def quality(risk: float = 0.02, delta: float = 0.05) -> str:
    """Counts over words and lines, then cutoffs by exact binomial tails on the documents labelled good."""
    rules = {r: cuts for r, (_, cuts) in QUALITY_RULES.items()}
    each = risk / len(rules)
    after = ", ".join(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, 5))
    counted = ", ".join(f"count(*) FILTER ({_BADNESS[r]} > {c}) AS {r}_{i}" for r, cuts in rules.items() for i, c in enumerate(cuts))
    tail = lambda k: (
        f"CASE WHEN {k} > n * {each}::DOUBLE THEN 1.0 ELSE list_sum(list_transform(range({k} + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({each}::DOUBLE) + (n - j) * ln(1 - {each}::DOUBLE)))) END"
    )
    chosen = ", ".join("least(" + ", ".join(f"CASE WHEN {tail(f'{r}_{i}')} <= level THEN {c}::DOUBLE END" for i, c in enumerate(cuts)) + f") AS cut_{r}" for r, cuts in rules.items())
    rejected = " OR ".join(f"coalesce({_BADNESS[r]} > cut_{r}, false)" for r in rules)
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d WHERE len(w) >= 5),
grams AS (SELECT doc_id, p, word, {after} FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT doc_id, unnest(list(p)) AS p FROM grams WHERE w4 IS NOT NULL GROUP BY doc_id, word, w1, w2, w3, w4 HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM twice, range(5) t(k) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS ln FROM d),
f AS (SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, greatest(len(ln), 1)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lined USING (doc_id) LEFT JOIN repeated USING (doc_id)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT lang AS stratum, count(*) AS n, {counted} FROM f JOIN good USING (doc_id) WHERE n_words > 0 GROUP BY lang),
levels AS (SELECT *, {delta}::DOUBLE / (greatest((SELECT count(*) FROM counts), 1) * {len(rules)}) AS level FROM counts),
cuts AS (SELECT stratum, {chosen} FROM levels)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words > 0 AND ({rejected})) AS kept
FROM f LEFT JOIN cuts ON lang IS NOT DISTINCT FROM stratum"""


def mixing(seed: str = "mix", cap: int = 3) -> str:
    """Targets by filling up to the caps in order of cap over weight; copies by a running sum in order of size."""
    return f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source),
weighed AS (SELECT source, n, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3] AS w FROM sources),
ordered AS (SELECT *, row_number() OVER o AS k, sum({cap} * n) OVER o - {cap} * n AS below, sum(w) OVER o - w AS w_below FROM weighed WINDOW o AS (ORDER BY {cap} * n / w::DOUBLE, source ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, ((SELECT sum(n) FROM sources) - below)::DOUBLE / ((SELECT sum(w) FROM weighed) - w_below) AS level FROM ordered),
free AS (SELECT min(k) AS k, min_by(level, k) AS level FROM levels WHERE w * level <= {cap} * n),
plan AS (SELECT o.source, o.n AS source_size, CASE WHEN free.k IS NULL OR o.k < free.k THEN ({cap} * o.n)::DOUBLE ELSE o.w * free.level END AS target FROM ordered o, free),
planned AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS units,
  ('0x' || substr(md5('{seed}:' || coalesce(s.source, chr(0))), 1, 6))::BIGINT AS shift FROM sized s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source),
summed AS (SELECT *, (sum(units) OVER (PARTITION BY source ORDER BY size, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT + shift AS upto FROM planned),
drawn AS (SELECT *, (upto >> 24) - ((upto - units) >> 24) AS copies FROM summed)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM drawn"""


def conversations() -> str:
    """Damage, faults, and cheapest edits by a recursion over turns that carries the best (cost, audit, lines) of each state."""
    byte = "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT), lambda c, b: {byte}), 4294967295) % 20"
    best = lambda *c: f"list_min([{', '.join(c)}])"
    grow = lambda s, cost, letter, line: f"CASE WHEN {s} IS NOT NULL THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {line}}} END"
    none, own, new = "[]::VARCHAR[]", "[role || ':' || text]", "['%s:' || text]"
    gone = lambda s: grow(s, 3, "D", none)
    keep = lambda s, i: f"CASE WHEN fault NOT IN (1, 2) AND initial = '{i}' THEN {grow(s, 'trunc', 'K', own)} END"
    turn = lambda s, role: f"CASE WHEN fault NOT IN (1, 2) THEN {grow(s, '2 + trunc', 'R', new % role)} END"
    put = lambda s, role: grow(s, 2, "I", f"['{role}:']")
    u = best("t2", put("t0", "user"), put("t1", "user"), put("t3", "user"))
    to2 = [gone("s2"), *[x for s in ("s0", "s1", "s3") for x in (keep(s, "u"), turn(s, "user"))]]
    edge = "coalesce(lag(initial) OVER w || initial, 'su') NOT IN ('su', 'ua', 'au')"
    state = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR[])"
    return f"""WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT *, {crc} AS x FROM plain),
damaged AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN x = 1 THEN '' WHEN x = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN x = 0 THEN 0 WHEN x = 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS rn FROM damaged),
marked AS (SELECT conv_id, turn, role, text, rn, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS seen FROM ordered),
faulty AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM marked),
d AS (SELECT *, (fault = 3)::BIGINT AS trunc, {edge} AS bad, count(*) OVER (PARTITION BY conv_id) AS n FROM faulty WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': {none}}}::{state} AS s0, NULL::{state} AS s1, {{'c': 2, 'a': 'I', 'o': ['user:']}}::{state} AS s2, {{'c': 4, 'a': 'II', 'o': ['user:', 'assistant:']}}::{state} AS s3 FROM (SELECT DISTINCT conv_id FROM d) z
  UNION ALL
  SELECT conv_id, i, t0, t1, u, {best("t3", put("u", "assistant"))} FROM (
    SELECT *, {u} AS u FROM (
      SELECT w.conv_id, d.rn AS i, {gone("s0")} AS t0, {best(gone("s1"), keep("s0", "s"))} AS t1, {best(*to2)} AS t2, {best(gone("s3"), keep("s2", "a"), turn("s2", "assistant"))} AS t3
      FROM walk w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.rn = w.i + 1) a) b),
ends AS (SELECT walk.conv_id, {best("s0", "s3")} AS e FROM walk JOIN (SELECT DISTINCT conv_id, n FROM d) z ON z.conv_id IS NOT DISTINCT FROM walk.conv_id AND z.n = walk.i),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (bad) AS illegal FROM d GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets(), "op4_near_dedup": near_dedup(), "op6_quality": quality(), "op10_mixing": mixing(), "op13_conversations": conversations()}
