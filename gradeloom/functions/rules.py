"""Ordered rule tables: first match wins.  Every table is a parameter with a fixed default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import text as X

# ---- fixed values: rule tables ------------------------------------------------------------
VARIANT_RULES = [
    ("claim_and_reason", r"(?i)reason on which th(?:at|e) claim is based"),
    ("claim_challenge", r"(?i)could be used to challenge your position"),
    ("recommendation", r"(?i)adopting the recommendation"),
    ("two_views", r"(?i)which view more closely aligns"),
    ("policy", r"(?i)views on the policy"),
    ("statement", r"(?i)agree or disagree with the statement"),
]
INSTRUCTION_OPENER = r"Write a response in which "
# Full-span instructions as printed in a topic pool; matched from the opener on.
VARIANT_SPANS = [
    ("statement", INSTRUCTION_OPENER + r".*?explain how these considerations shape your position\."),
    ("claim_challenge", INSTRUCTION_OPENER + r".*?that could be used to challenge your position\."),
    ("claim_and_reason", INSTRUCTION_OPENER + r".*?reason on which th(?:at|e) claim is based\."),
    ("recommendation", INSTRUCTION_OPENER + r".*?explain how these examples shape your position\."),
    ("two_views", INSTRUCTION_OPENER + r".*?address both of the views presented\."),
    ("policy", INSTRUCTION_OPENER + r".*?explain how these consequences shape your position\."),
]
DOMAIN_RULES = [
    ("education", r"(?i)\b(school|student|educat|teach|universit|colleg|learn|curricul)"),
    ("government", r"(?i)\b(government|polit|law|state|nation|citizen|public|societ)"),
    ("science_tech", r"(?i)\b(scien|technolog|research|innovat|discover|engineer)"),
    ("arts_culture", r"(?i)\b(art|artist|music|literat|culture|creativ|film)"),
    ("work_business", r"(?i)\b(business|employ|work|corporat|industr|econom|profit)"),
    ("individual", r"(?i)\b(individual|person|character|moral|happ|success|leader)"),
]
# Openers that separate a statement from its task instruction, per caller.
OPENER_GOLD = r"Write a response in which"
OPENER_TESTSET = r"(?:Write a response in which|Discuss the extent to which)"
OPENER_ANCHOR = r"(?:Write a response in which you discuss|Discuss the extent to which)"

ARGUMENT_PROMPT = (
    r"(?i)(the following (?:appeared|was (?:published|taken)|is (?:a|an|part of|taken))\s+"
    r"(?:appeared\s+)?(?:in|as|from|a|an)?\s*"
    r"(?:memo|memorandum|letter|report|article|recommendation|editorial|passage|excerpt|statement|"
    r"advertisement|note|proposal|column|newsletter|press release|part of)"
    r"|examine the stated and/or unstated assumptions"
    r"|what specific evidence is needed to evaluate"
    r"|questions would need to be answered in order to decide"
    r"|alternative explanations that could rival)"
)
ISSUE_PROMPT = (
    r"(?i)(discuss the extent to which you agree or disagree"
    r"|discuss which view more closely aligns"
    r"|discuss your views on the policy"
    r"|address the most compelling reasons and/or examples"
    r"|describe specific circumstances in which adopting the recommendation)"
)
ARGUMENT_TITLE = r"\bargument\b (?:task|essay|prompt)|\bargument (?:task|essay)\b"
ISSUE_TITLE = r"\bissue\b (?:task|essay|prompt)|\bissue (?:task|essay)\b"
ARGUMENT_BODY = (
    r"(?i)\b(unstated assumption|the author assumes|assumes that|the argument "
    r"(?:is|would be) (?:weak|strong|flaw)|logical fallac|unwarranted|"
    r"the memo|the recommendation is based|evidence (?:is|are) needed|"
    r"the conclusion (?:is|rests|depends))"
)
ISSUE_BODY = (
    r"(?i)\b(i (?:strongly |largely |partially |whole?heartedly )?(?:agree|disagree)"
    r"|in my (?:opinion|view)|the statement (?:claims|asserts|suggests|implies)"
    r"|i concur|my (?:position|stance|standpoint)|the speaker (?:claims|asserts|"
    r"argues|contends)|the (?:claim|recommendation|policy) (?:that|is)"
    r"|to (?:a (?:large|great|certain) extent|some extent)"
    r"|the extent to which i agree)"
)
STANDARD_INSTRUCTION = r"(?i)write a response in which you"
GENERATED_TEXT_TELLS = (
    r"(?i)(as an ai language model|i'm sorry, (?:but )?i can(?:'t|not)|"
    r"here (?:is|'s) (?:a|an) (?:sample|model) (?:essay|response)|"
    r"certainly! |in conclusion, it is (?:clear|evident) that the (?:above|foregoing))"
)
GENERATED_TEXT_NOTE = (
    "FLAG: text contains a phrase typical of LLM output; authenticity downgraded."
)
CUTOFF_DATE = "2022-11-30"
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
]
# -------------------------------------------------------------------------------------------


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first rule whose pattern occurs in ``text``."""
    arms = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]
    return F.coalesce(*arms, F.lit(default).cast("string"))


def classify_variant(instruction: Column, rules=VARIANT_RULES) -> Column:
    return first_match(instruction, rules)


def classify_variant_span(segment: Column, spans=VARIANT_SPANS) -> Column:
    """Struct(variant, instruction) for the first full-span rule anchored at the segment start."""
    arms = [
        F.when(segment.rlike("^(?:" + rx + ")"),
               F.struct(F.lit(name).alias("variant"), F.regexp_extract(segment, "^(?:" + rx + ")", 0).alias("instruction")))
        for name, rx in spans
    ]
    return F.coalesce(*arms)


def domain_of(statement: Column, rules=DOMAIN_RULES) -> Column:
    return first_match(statement, rules, "general")


def split_prompt(text: Column, opener: str, squeeze: bool = True) -> Column:
    """Struct(statement, instruction): the instruction runs from the first opener to the end."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(t, f"(?s)(?:{opener}).*$", 0)
    statement = F.when(found == "", t).otherwise(F.left(t, F.length(t) - F.length(found)))
    instruction = X.squeeze_ws(found) if squeeze else found
    return F.struct(
        X.strip_ws(statement).alias("statement"),
        F.nullif(X.strip_ws(instruction), F.lit("")).alias("instruction"),
    )


def is_task_prompt(prompt: Column) -> Column:
    p = F.coalesce(prompt, F.lit(""))
    return p.rlike(ARGUMENT_PROMPT) | p.rlike(ISSUE_PROMPT) | p.rlike(STANDARD_INSTRUCTION)


def register_hits(essay: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(essay, F.lit("")), F.lit(pattern))


def classify_task(
    prompt: Column, essay: Column, title: Column,
    argument_prompt=ARGUMENT_PROMPT, issue_prompt=ISSUE_PROMPT,
    argument_title=ARGUMENT_TITLE, issue_title=ISSUE_TITLE,
    argument_body=ARGUMENT_BODY, issue_body=ISSUE_BODY,
) -> Column:
    """Prompt wording decides first, then the title, then which register the body uses more."""
    p = F.coalesce(prompt, F.lit(""))
    t = F.lower(F.coalesce(title, F.lit("")))
    arg, iss = register_hits(essay, argument_body), register_hits(essay, issue_body)
    return (
        F.when(p.rlike(argument_prompt), "argument")
        .when(p.rlike(issue_prompt), "issue")
        .when(t.rlike(argument_title), "argument")
        .when(t.rlike(issue_title), "issue")
        .when(arg > iss, "argument")
        .when(iss > arg, "issue")
        .otherwise("unknown")
    )


def type_from_slug(category: Column, prompt: Column) -> Column:
    """Page category names the task; otherwise the head of the prompt decides."""
    low = F.lower(F.coalesce(prompt, F.lit("")))
    reads_argument = F.contains(F.left(low, F.lit(120)), F.lit("the following")) | F.contains(
        F.left(low, F.lit(200)), F.lit("appeared in"))
    return (
        F.when(F.contains(category, F.lit("issue")), "issue")
        .when(F.contains(category, F.lit("argument")), "argument")
        .when(reads_argument, "argument")
        .otherwise("issue")
    )


def type_from_question(task: Column, prompt: Column, pattern: str = r"(?i)do you agree or disagree") -> Column:
    return F.when((task == "unknown") & prompt.rlike(pattern), "issue").otherwise(task)


def flag_generated(auth: Column, notes: Column, text: Column, pattern: str = GENERATED_TEXT_TELLS):
    """(authenticity, notes, flagged): the row stays, its authenticity is downgraded."""
    hit = text.rlike(pattern)
    return *downgraded(auth, notes, hit), hit


def downgraded(auth: Column, notes: Column, hit: Column):
    note = F.regexp_replace(
        F.concat(F.coalesce(notes, F.lit("")), F.lit(" | " + GENERATED_TEXT_NOTE)), r"^[ |]+|[ |]+$", "")
    return F.when(hit, "uncertain").otherwise(auth), F.when(hit, note).otherwise(notes)


def authenticity_from_date(date: Column, after: str, undated: str = "likely", dated: str = "confirmed",
                           cutoff: str = CUTOFF_DATE, cutoff_counts_as_after: bool = False) -> Column:
    """One source's policy: what a date past the cutoff, an earlier date and no date mean."""
    late = (date >= cutoff) if cutoff_counts_as_after else (date > cutoff)
    return F.when(date.isNull(), undated).when(late, after).otherwise(dated)


def authorship_note(date: Column, author: Column, cutoff: str = CUTOFF_DATE) -> Column:
    """What a record's date says about who wrote it."""
    who = F.coalesce(author, F.lit("unknown"))
    return F.when(date.isNull(), F.concat(F.lit("Attributed to the account "), who, F.lit("; no date is known."))).when(
        date > cutoff, F.concat(F.lit("Posted "), date, F.lit(", after writing tools went public; machine authorship cannot be ruled out."))).otherwise(
        F.concat(F.lit("Posted "), date, F.lit(" by "), who, F.lit(", before public writing tools existed.")))


def iso_date_from_text(text: Column) -> Column:
    """First of three layouts: 09/14/2019, 07 March 2014, March 7, 2014; else NULL."""
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    t = X.strip_ws(text)

    def built(year, month, day):
        return F.format_string("%s-%02d-%02d", year, month, day)

    slash = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    day_first = r"(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
    month_first = r"([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})"
    g = lambda rx, i: F.regexp_extract(t, rx, i)
    as_int = lambda c: c.try_cast("int")
    month_of = lambda c: F.array_position(months, F.lower(c)).cast("int")
    return F.coalesce(
        F.when(t.rlike(slash), built(g(slash, 3), as_int(g(slash, 1)), as_int(g(slash, 2)))),
        F.when(t.rlike(day_first) & (month_of(g(day_first, 2)) > 0),
               built(g(day_first, 3), month_of(g(day_first, 2)), as_int(g(day_first, 1)))),
        F.when(t.rlike(month_first) & (month_of(g(month_first, 1)) > 0),
               built(g(month_first, 3), month_of(g(month_first, 1)), as_int(g(month_first, 2)))),
    )


def forum_date(text: Column, as_of: str | None = None) -> Column:
    """'7 Mar 2014' style; a date of ``as_of`` (today, unless given) or later is page furniture and becomes NULL."""
    before = F.current_date().cast("string") if as_of is None else F.lit(as_of)
    rx = r"^\s*(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})"
    months = F.array(*[F.lit(m[:3]) for m in MONTH_NAMES])
    month = F.array_position(months, F.lower(F.regexp_extract(text, rx, 2))).cast("int")
    iso = F.format_string("%s-%02d-%02d", F.regexp_extract(text, rx, 3), month,
                          F.regexp_extract(text, rx, 1).try_cast("int"))
    return F.when(text.rlike(rx) & (month > 0) & (iso < before), iso)


def epoch_date(seconds: Column) -> Column:
    """UTC calendar day, whatever the session time zone."""
    day = F.floor(seconds / 86400).cast("int")
    return F.when(seconds != 0, F.date_add(F.lit("1970-01-01").cast("date"), day).cast("string"))
