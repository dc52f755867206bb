"""DuckDB SQL of the queries that SQL can express."""

from .secrets import ALLOWED

_WINDOW = 50

#: Every window of every document as text; the smallest document that has it; the words that the later ones lose.
OP6 = f"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {_WINDOW - 2})) AS start FROM split WHERE len(words) >= {_WINDOW}),
held AS (SELECT doc_id, start, md5(array_to_string(words[start : start + {_WINDOW - 1}], ' ')) AS run FROM starts),
first AS (SELECT run, min(doc_id) AS least FROM held GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + {_WINDOW})) AS pos FROM held JOIN first USING (run) WHERE doc_id > least),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM split s LEFT JOIN kept k USING (doc_id)"""


def _words(text: str) -> str:
    """Lower-cased words between ASCII punctuation, controls and white space."""
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+')"


def _grams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i : i + 4], ' ')))"


def _share(part: str) -> str:
    """The share of a part's 5-grams in the document; what is no longer than one is sought as a run of words."""
    run = f"len({part}) > 0 AND contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string({part}, ' ') || ' ')"
    return f"CASE WHEN len({part}) <= 5 THEN ({run})::INT::DOUBLE ELSE len(list_intersect({_grams(part)}, {_grams('d.words')})) / len({_grams(part)}) END"


_WHITE = "[\\x09-\\x0d\\x20]+"
#: BM25 of every passage for every piece it shares a term with, without an index.
OP10 = f"""WITH item AS (SELECT row_number() OVER (ORDER BY item_id, text) AS k, item_id, text, {_words('text')} AS words FROM benchmark WHERE text IS NOT NULL),
piece AS (SELECT k, p, words[len(words) * p // n + 1 : len(words) * (p + 1) // n] AS words FROM (SELECT *, unnest(range(n)) AS p FROM (SELECT k, words, (len(words) + 63) // 64 AS n FROM item))),
term AS (SELECT k, p, len, t, count(*) AS f FROM (SELECT k, p, len(words) AS len, unnest(words) AS t FROM piece) GROUP BY ALL),
known AS (SELECT t, count(*) AS df FROM term GROUP BY t),
raw AS (SELECT k, p, t, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS x FROM term JOIN known USING (t), (SELECT count(*) AS n, avg(len(words)) AS mean FROM piece)),
weight AS (SELECT k, p, t, x / sum(x) OVER (PARTITION BY k, p) AS x FROM raw),
doc AS (SELECT doc_id, {_words("coalesce(text, '')")} AS words FROM documents),
cell AS (SELECT DISTINCT doc_id, i // 64 AS c, t FROM (SELECT doc_id, unnest(words) AS t, unnest(range(len(words))) AS i FROM doc) SEMI JOIN known USING (t)),
passage AS (SELECT doc_id, c, t FROM cell UNION SELECT doc_id, c - 1, t FROM cell WHERE c > 0),
found AS (SELECT doc_id, k, max(s) AS score FROM (SELECT doc_id, c, k, p, sum(x) AS s FROM passage JOIN weight USING (t) GROUP BY ALL HAVING sum(x) >= 0.6::DOUBLE) GROUP BY ALL),
sentence AS (SELECT k, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '^{_WHITE}|{_WHITE}$', '', 'g'), '([.!?]){_WHITE}', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_words('s')}), lambda w: len(w) > 0) AS s FROM item),
part AS (SELECT k, CASE WHEN len(s) > 1 THEN flatten(s[: len(s) - 1]) ELSE s[1][: (len(s[1]) + 1) // 2] END AS question, CASE WHEN len(s) > 1 THEN s[len(s)] ELSE s[1][(len(s[1]) + 1) // 2 + 1 :] END AS answer FROM sentence),
judged AS (SELECT f.doc_id, item_id, score, {_share('question')} AS question_overlap, {_share('answer')} AS answer_overlap FROM found f JOIN doc d ON d.doc_id = f.doc_id JOIN item USING (k) JOIN part USING (k))
SELECT doc_id, item_id, round(score, 6) AS score, round(question_overlap, 6) AS question_overlap, round(answer_overlap, 6) AS answer_overlap FROM judged WHERE least(question_overlap, answer_overlap) >= 0.5"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = f"""({'|'.join(_either(w) for w in ('password', 'passwd', 'secret', 'token', 'api_?key'))})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _located(kind: int, pattern: str) -> str:
    """Matches from left to right: what is before each, and so its place in code points."""
    pieces = f"SELECT doc_id, unnest(m) AS hit, unnest(regexp_split_to_array(text, '{pattern}')[: len(m)]) AS gap, unnest(range(len(m))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}', 0) AS m FROM doc) WHERE len(m) > 0"
    return f"SELECT doc_id, {kind} AS kind, hit, CAST(upto - len(hit) AS BIGINT) AS start, CAST(upto AS BIGINT) AS stop FROM (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ({pieces}))"


_INSIDE = "EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.start <= x.start AND x.stop <= b.stop)"
_ALLOWED = ALLOWED.replace("\\", "\\\\")
#: Spans by pattern; every window of every other candidate, its characters counted anew.
OP5 = f"""WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (SELECT * FROM ({_located(0, _ASSIGN)}) WHERE len(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6 UNION ALL {_located(1, 'AKIA[A-Z0-9]{16,}')} UNION ALL {_located(2, '[0-9a-f]{24,}')}),
candidate AS (SELECT *, CASE WHEN regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 3.0::DOUBLE WHEN regexp_full_match(hit, '[A-Z0-9]+') THEN 3.5::DOUBLE ELSE 3.75::DOUBLE END AS bits FROM ({_located(3, '[A-Za-z0-9+/_-]{20,}')}) x WHERE regexp_matches(hit, '[0-9]') AND NOT regexp_matches(hit, '{_ALLOWED}') AND NOT {_INSIDE}),
letter AS (SELECT doc_id, start, bits, i, substring(hit, CAST(i + j AS BIGINT), 1) AS c FROM (SELECT *, unnest(range(1, len(hit) - 18)) AS i FROM candidate), range(20) r(j)),
windows AS (SELECT doc_id, start, i, any_value(bits) AS bits, sum(n * log2(n)) AS s FROM (SELECT doc_id, start, i, c, any_value(bits) AS bits, count(*) AS n FROM letter GROUP BY doc_id, start, i, c) GROUP BY doc_id, start, i),
added AS (SELECT * FROM (SELECT doc_id, start + min(i) - 1 AS start, start + max(i) + 19 AS stop FROM windows WHERE 20 * (log2(20) - bits) >= s - 1e-9 GROUP BY doc_id, windows.start) x WHERE NOT {_INSIDE}),
every AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, 3, start, stop FROM added),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS span FROM every),
joined AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind, stop) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN joined USING (doc_id)"""

ORACLES: dict[str, str] = {"op5_secrets": OP5, "op6_substring_dedup": OP6, "op10_decontamination": OP10}
