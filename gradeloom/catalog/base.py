"""Registry of queries over the given tables and the SQL pieces their checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows are checked."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return add


# Lexicons made of words that occur in the given texts.
CONCESSION = ["the", "for", "whether", "with that", "and the"]
FORMULAIC = ["of", "in the", "that is", "les", "der"]
STOP = ["that", "with", "this", "from", "dans", "pour"]
TELLS = r"(?i)(released under|erent the| de la que )"
TELLS_SQL = r"(?i)(released under|erent the| de la que )"
VARIANT_RULES = [
    ("claim_and_reason", r"(?i)license"), ("claim_challenge", r"(?i) the of "), ("recommendation", r"(?i) und der "),
    ("two_views", r"(?i) de la "), ("policy", r"(?i) el "), ("statement", r"(?i) that "),
]
DOMAIN_RULES = [
    ("education", r"(?i)\b(edu|teach|thhe)"), ("government", r"(?i)\b(state|that)"), ("science_tech", r"(?i)\b(tion)"),
    ("arts_culture", r"(?i)\b(art|erin)"), ("work_business", r"(?i)\b(work|onth)"), ("individual", r"(?i)\b(person|rest)"),
]


# Patterns without alternatives that differ between engines.
SIGNAL_RULES = VARIANT_RULES


def lst(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def case_rules(expr: str, rules: list[tuple[str, str]], default: str = "NULL") -> str:
    arms = " ".join(f"WHEN regexp_matches({expr}, '{rx}') THEN '{name}'" for name, rx in rules)
    return f"CASE {arms} ELSE {default} END"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def squeeze(expr: str) -> str:
    return rf"regexp_replace({expr}, '\s+', ' ', 'g')"


def norm(expr: str, accents: bool = True) -> str:
    """The exact-duplicate key: an accented letter becomes its base letter and a space."""
    e = f"lower({expr})"
    if accents:
        # fixed values: the accented letters of the given texts
        for letters, base in [("\u00e9\u00e8\u00ea", "e"), ("\u00e4\u00e1\u00e0\u00e2", "a"), ("\u00f3\u00f6", "o"), ("\u00fc", "u"), ("\u00ed", "i"), ("\u00f1", "n"), ("\u00e7", "c")]:
            e = f"regexp_replace({e}, '[{letters}]', '{base} ', 'g')"
    return f"trim(regexp_replace({e}, '[^a-z0-9]+', ' ', 'g'))"


def wc(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '[A-Za-z0-9'']+'))::INTEGER"


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '[a-z][a-z''-]*')"


def content(words_expr: str, stop: list[str]) -> str:
    return f"list_distinct(list_filter({words_expr}, lambda w: length(w) > 3 AND NOT list_contains({lst(stop)}, w)))"


def sents(expr: str) -> str:
    marked = rf"regexp_replace({expr}, '([.!?])[\"'')\]]*\s+', '\1' || chr(1), 'g')"
    parts = f"list_transform(string_split({marked}, chr(1)), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: regexp_matches(s, '[A-Za-z]'))"


def nonblank(list_expr: str) -> str:
    return f"list_filter(list_transform({list_expr}, lambda p: {strip('p')}), lambda p: p <> '')"


def marker_list(expr: str, lexicon: list[str]) -> str:
    return (f"list_filter({lst(lexicon)}, lambda n: "
            f"regexp_matches(' ' || lower({expr}) || ' ', '[^a-z]' || n || '[^a-z]'))")


def r3(expr: str, digits: int = 3) -> str:
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


def grams(source: str, id_col: str, key: str) -> str:
    """CTE gram(id, g): distinct five-token shingles of a normalised key, one row each."""
    w = f"OVER (PARTITION BY {id_col} ORDER BY i)"
    return f"""tok AS (SELECT {id_col}, unnest(toks) AS w, generate_subscripts(toks, 1) AS i, len(toks) AS n FROM
  (SELECT {id_col}, list_filter(string_split({key}, ' '), lambda x: x <> '') AS toks FROM {source})),
gram5 AS (SELECT {id_col}, i, n, lead(w, 4) {w} AS last, concat_ws(' ', w, lead(w, 1) {w}, lead(w, 2) {w}, lead(w, 3) {w}, lead(w, 4) {w}) AS g FROM tok),
gram AS (SELECT DISTINCT {id_col}, g FROM gram5 WHERE last IS NOT NULL OR (n < 5 AND i = 1))"""


def stated(idle: int = 0) -> str:
    """Join of documents d with the benchmark text b of each: item rank = doc_id modulo the number of items."""
    return f"""LEFT JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM benchmark WHERE item_id IS NOT NULL) b
    ON b.slot = d.doc_id % nullif((SELECT count(*) + {idle} FROM benchmark WHERE item_id IS NOT NULL), 0)"""


ESSAYS = f"""essays AS (
  SELECT d.doc_id AS ordinal, 'doc_' || d.doc_id AS essay_id, d.text AS essay_text,
    CASE d.doc_id % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'argument' ELSE 'unknown' END AS essay_type,
    b.text AS prompt_text,
    CASE WHEN d.doc_id % 6 <> 5 THEN (d.doc_id % 13)::DOUBLE / 2 END AS score,
    d.doc_id % 6 <> 5 AS score_available,
    CASE d.doc_id % 6 WHEN 0 THEN 'official' WHEN 1 THEN 'teacher_rated' WHEN 2 THEN 'self_reported'
      WHEN 3 THEN 'third_party_rated' WHEN 4 THEN 'estimated' ELSE 'none' END AS score_type,
    d.doc_id % 6 AS score_rank,
    CASE d.doc_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'uncertain' END AS human_authenticity,
    d.doc_id % 3 AS auth_rank,
    d.source AS source_name, 'u/' || d.doc_id AS source_url,
    CASE WHEN d.doc_id % 7 <> 0 THEN strftime(DATE '2022-01-01' + d.doc_id::INTEGER, '%Y-%m-%d') END AS publication_date,
    {wc('d.text')} AS word_count
  FROM documents d {stated()})"""

SUBTYPE = """CASE score_type WHEN 'official' THEN 'A1_official' WHEN 'teacher_rated' THEN 'A2_teacher_rated'
  WHEN 'self_reported' THEN 'A2_teacher_rated' WHEN 'third_party_rated' THEN 'A3_community_rated'
  WHEN 'estimated' THEN 'B1_machine_scored' ELSE 'B2_unscored' END"""
HUMAN = "score_type IN ('official', 'teacher_rated', 'self_reported', 'third_party_rated')"
PRIORITY = f"""CASE WHEN score_type = 'official' THEN 1 WHEN {HUMAN} THEN 2
  WHEN human_authenticity IN ('confirmed', 'likely') THEN 3 ELSE 4 END"""
LABELLED = f"""{ESSAYS}, labelled AS (SELECT *, {SUBTYPE} AS subtype, CASE WHEN {HUMAN} THEN 'A' ELSE 'B' END AS data_type,
  {PRIORITY} AS priority FROM essays)"""
REASON = r"""CASE WHEN word_count < (CASE WHEN score_type IN ('official', 'teacher_rated') THEN 10 ELSE 100 END) THEN 'too_short'
  WHEN word_count > 3000 THEN 'too_long'
  WHEN length(regexp_replace(essay_text, '\PL+', '', 'g')) < length(essay_text) * 0.5 THEN 'not_prose' END"""
KEPT = f"""{ESSAYS}, kept AS (SELECT * FROM (SELECT *, {REASON} AS drop_reason FROM essays) WHERE drop_reason IS NULL)"""
RANKED = f"""{KEPT}, keyed AS (SELECT *, {norm('essay_text')} AS key FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score_rank, auth_rank,
    CASE WHEN coalesce(prompt_text, '') <> '' THEN 0 ELSE 1 END, -word_count, ordinal) AS rn,
    count(*) OVER (PARTITION BY key) AS copies FROM keyed),
survivors AS (SELECT *, copies - 1 AS duplicate_count FROM ranked WHERE rn = 1)"""
PREDS = """preds AS (
  SELECT d.doc_id AS ordinal, d.source || '_score' || (d.doc_id % 10) AS id, d.source AS ladder, 'doc_' || d.doc_id AS item_id,
    (d.doc_id % 13)::DOUBLE / 2 AS true_score, ((d.doc_id * 7 + d.n_chars) % 13)::DOUBLE / 2 AS predicted_score,
    CASE WHEN l.quality = 1 THEN 'official' ELSE 'teacher_rated' END AS label_source
  FROM documents d JOIN labels l USING (doc_id))"""
ANCHORS = """anchors AS (
  SELECT d.doc_id AS ordinal, d.source || '_' || d.doc_id AS id, (d.doc_id % 6 + 1)::DOUBLE AS score, d.source AS grp,
    d.text AS essay FROM documents d JOIN labels l USING (doc_id))"""
POOL = """pool AS (
  SELECT item_id * 2 + copy AS ordinal, text AS statement,
    ['claim_and_reason', 'claim_challenge', 'recommendation', 'two_views', 'policy', 'statement'][(item_id + copy) % 6 + 1] AS variant,
    'issue_' || left(sha1(variant || chr(10) || text), 10) AS id,
    'Write a response in which you treat ' || variant || '.' AS instruction
  FROM (SELECT item_id, text, unnest(CASE WHEN item_id % 8 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM benchmark))"""
