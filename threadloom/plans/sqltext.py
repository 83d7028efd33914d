"""Shared fragments of the check SQL: common table expressions over the given tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from threadloom.functions.lexicons import STOP_WORDS

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SOLID = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"

TURNS = """turns AS (
  SELECT conv_id AS conversation_id, turn + 1 AS turn_number,
         CASE role WHEN 'user' THEN 'customer' ELSE 'brand' END AS speaker, text
  FROM conversations WHERE role IN ('user', 'assistant'))"""

TWEETS = """tw AS (
  SELECT conv_id * (SELECT max(turn) + 2 FROM conversations) + turn AS tweet_id, conv_id, turn,
         role = 'user' AS inbound,
         CASE WHEN role = 'user' THEN 'user' || (conv_id % 37) ELSE 'Brand' || (conv_id % 5) END AS author_id,
         TIMESTAMP '2017-10-30 10:00:00' + to_hours((conv_id % 1000)::INT) + to_minutes(turn::INT) AS posted,
         conv_id % 17 = 3 AND turn = 1 AS broken,
         CASE WHEN role = 'user' AND turn % 3 = 0 THEN '@Brand' || ((conv_id + turn) % 7) || ' ' ELSE '' END
           || text AS text
  FROM conversations WHERE role IN ('user', 'assistant')),
tweets AS (
  SELECT tweet_id, conv_id, turn, inbound, author_id, text,
         CASE WHEN (conv_id + turn) % 4 = 3 THEN (tweet_id + 1) || ',' || (tweet_id + 2) ELSE (tweet_id + 1)::VARCHAR END
           AS response_tweet_id,
         CASE WHEN broken THEN 'unknown' ELSE strftime(posted, '%a %b %d %H:%M:%S +0000 %Y') END AS created_at,
         CASE WHEN broken THEN NULL ELSE posted END AS ts,
         CASE WHEN turn > 0 THEN tweet_id - 1
              WHEN conv_id % 7 = 0 THEN -(conv_id // 21) - 1 END AS parent_id,
         CASE WHEN (conv_id + turn) % 4 = 3 THEN NULL ELSE tweet_id + 1 END AS answer_id
  FROM tw),
edges AS (
  SELECT DISTINCT tweet_id AS src, parent_id AS dst FROM tweets WHERE parent_id IS NOT NULL
  UNION
  SELECT tweet_id, answer_id FROM tweets WHERE answer_id IS NOT NULL)"""

# Closure of the reply graph by recursion, independent of the star contraction.
THREADS = (
    TWEETS
    + """,
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (
  SELECT tweet_id, tweet_id FROM tweets
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
threads AS (
  SELECT r.a AS tweet_id, min(r.b) AS thread
  FROM reach r WHERE r.b IN (SELECT tweet_id FROM tweets) GROUP BY r.a),
tt AS (SELECT t.*, h.thread FROM tweets t JOIN threads h USING (tweet_id)),
bt AS (
  SELECT *, 'conv_' || thread AS conversation_id,
         CASE WHEN lower(author_id) LIKE 'brand%' THEN 'brand' ELSE 'customer' END AS speaker
  FROM tt WHERE thread IN (SELECT thread FROM tt WHERE lower(author_id) IN
    ('brand0', 'brand1', 'brand2', 'brand3', 'brand4')))"""
)


def quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def bare(text: str) -> str:
    """Mentions, then links, then outer white space removed."""
    no_names = f"regexp_replace({text}, '@{WORD}+', '', 'g')"
    return strip(f"regexp_replace({no_names}, 'http{SOLID}+', '', 'g')")


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{SOLID}+'))"


def fingerprint(text: str) -> str:
    no_names = f"regexp_replace(lower({text}), '@{WORD}+', '', 'g')"
    no_links = f"regexp_replace({no_names}, 'http{SOLID}+', '', 'g')"
    return f"regexp_replace({no_links}, '[^a-z0-9]', '', 'g')"


def tokens(name: str, source: str) -> str:
    """CTE ``name`` (doc_id, term), one row per kept token of ``source`` (doc_id, text)."""
    no_links = f"regexp_replace(lower(text), 'http{SOLID}+', '', 'g')"
    no_names = f"regexp_replace({no_links}, '@{WORD}+', '', 'g')"
    plain = f"translate({no_names}, '{PUNCT}', '')"
    return f"""{name} AS (
  SELECT doc_id, term FROM (
    SELECT doc_id, unnest(string_split_regex({plain}, '{SPACE}+')) AS term FROM {source}) u
  WHERE term <> '' AND NOT regexp_full_match(term, '[\\p{{Nd}}²³¹⁰⁴-⁹₀-₉]+')
    AND term NOT IN ({quoted(STOP_WORDS)}))"""


def vectors(name: str, source: str) -> str:
    """CTEs up to ``name`` (doc_id, term, w) and ``name_df`` (term, df, idf)."""
    return f"""{tokens(name + '_tok', source)},
{name}_tf AS (
  SELECT doc_id, term, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS doc_len
  FROM {name}_tok GROUP BY doc_id, term),
{name}_df AS (
  SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM {source})) / (1.0 + count(*))) + 1.0 AS idf
  FROM {name}_tf GROUP BY term),
{name}_x AS (
  SELECT doc_id, term, n::DOUBLE / doc_len * idf AS x FROM {name}_tf JOIN {name}_df USING (term)),
{name} AS MATERIALIZED (
  SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM {name}_x)"""


def retrieval(k: int, threshold: float, normalize: bool = True) -> str:
    """CTEs up to hits(query_id, rank, case_id, similarity): openings against documents."""
    weight = "1.0 / sqrt(count(*) OVER (PARTITION BY query_id))" if normalize else "1.0"
    fill = (
        """
  UNION ALL
  SELECT query_id, doc_id, 0.0 FROM (SELECT query_id FROM openings) q, documents d
  WHERE NOT EXISTS (SELECT 1 FROM sims s WHERE s.query_id = q.query_id AND s.case_id = d.doc_id)"""
        if threshold <= 0
        else ""
    )
    return f"""{TURNS},
{OPENINGS},
qsrc AS (SELECT query_id AS doc_id, text FROM openings),
{vectors('v', 'documents')},
{tokens('qtok', 'qsrc')},
qv AS (
  SELECT query_id, term, {weight} AS wq
  FROM (SELECT DISTINCT doc_id AS query_id, term FROM qtok) d WHERE term IN (SELECT term FROM v_df)),
sims AS MATERIALIZED (
  SELECT query_id, doc_id AS case_id, round(sum(wq * w), 9) AS similarity
  FROM qv JOIN v USING (term) GROUP BY query_id, doc_id),
cand AS (
  SELECT query_id, case_id, similarity FROM sims WHERE similarity >= {threshold}{fill}),
hits AS (
  SELECT query_id, case_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS rank
    FROM cand) r WHERE rank <= {k})"""


OPENINGS = """firsts AS (
  SELECT conversation_id, count(*) AS num_turns,
         min(turn_number) FILTER (speaker = 'customer') AS c_at FROM turns GROUP BY 1),
replies AS (
  SELECT t.conversation_id, min(t.turn_number) AS b_at FROM turns t JOIN firsts f USING (conversation_id)
  WHERE t.speaker = 'brand' AND t.turn_number > f.c_at GROUP BY 1),
cases AS (
  SELECT f.conversation_id, f.num_turns, c.text AS customer_message, coalesce(b.text, '') AS brand_response
  FROM firsts f
  JOIN turns c ON c.conversation_id = f.conversation_id AND c.turn_number = f.c_at
  LEFT JOIN replies r ON r.conversation_id = f.conversation_id
  LEFT JOIN turns b ON b.conversation_id = f.conversation_id AND b.turn_number = r.b_at),
openings AS (SELECT conversation_id AS query_id, customer_message AS text FROM cases)"""


def tags(text: str, lexicon: Mapping[str, Sequence[str]]) -> str:
    """List of the keys with a keyword in the text."""
    parts = []
    for key, keywords in lexicon.items():
        hit = " OR ".join(f"contains(lower({text}), '{w}')" for w in keywords)
        parts.append(f"CASE WHEN {hit} THEN '{key}' END")
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def any_of(text: str, keywords: Sequence[str]) -> str:
    if isinstance(keywords, str):
        raise TypeError("keywords must be a list of words, not one string")
    found = [f"contains(lower({text}), '{w}')" for w in keywords]
    return "(" + " OR ".join(found) + ")" if found else "false"


def first_rule(text: str, rules: Sequence[Sequence[str]], other: str) -> str:
    whens = " ".join(
        f"WHEN {any_of(text, r[1])} AND NOT {any_of(text, r[2])} THEN '{r[0]}'" for r in rules
    )
    return f"CASE {whens} ELSE '{other}' END"


def sample_key(key: str, seed: int = 42) -> str:
    return f"md5('{seed}|' || {key})"


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"
