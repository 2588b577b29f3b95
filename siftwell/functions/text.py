"""Text functions on columns: answers, numbers, ids and log entries out of free text. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns. (?U) makes \w, \d and \s Unicode classes.
BOXED = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
PLACEHOLDER = r"(?U)<image>\s*"
LAST_TOKEN = r"(?U)[\w\-]+"
BRACED = r"\{([^}]+)\}"
CHOICE_LETTER = r"^\(?([A-Ea-e])\)?$"
FLAT_BOX = r"\\boxed\{([^}]+)\}"
TRAILING_NUMBER = r"(-?\d+(?:\.\d+)?)\s*$"
INTEGER = r"-?\d+"
IMAGE_NAME = r"(?i)(\d+)\.(?:jpg|jpeg|png)$"
LOG_STEP = r"training/global_step\s*[:=]\s*(\d+)"
LOG_PAIR = r"(?U)([A-Za-z_][\w./\-]*)\s*[:=]\s*(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|nan|-?inf)"


def strip(c: Column) -> Column:
    """All white space off both ends, not blanks alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical(c: Column) -> Column:
    return F.lower(strip(c))


def has_boxed(c: Column) -> Column:
    return c.rlike(BOXED)


def boxed(c: Column) -> Column:
    """Trimmed payload of the first \\boxed{...} (one nested level); null if there is none, '' if it is empty."""
    return F.when(c.rlike(BOXED), strip(F.regexp_extract(c, BOXED, 1)))


def strip_placeholders(c: Column) -> Column:
    return strip(F.regexp_replace(c, PLACEHOLDER, ""))


def yes_no(c: Column) -> Column:
    """'yes' or 'no', whichever stands first as a mere substring; the lowered text if neither does."""
    low = F.lower(c)
    yes, no = F.instr(low, "yes"), F.instr(low, "no")
    return F.when((yes == 0) & (no == 0), low).when((yes > 0) & ((no == 0) | (yes < no)), "yes").otherwise("no")


def says_yes(c: Column) -> Column:
    return yes_no(c) == "yes"


def last_token(c: Column) -> Column:
    """The first {...} payload, else the last token, else the text; stripped and lowered."""
    tokens = F.regexp_extract_all(c, F.lit(LAST_TOKEN), F.lit(0))
    return F.when(c.rlike(BRACED), canonical(F.regexp_extract(c, BRACED, 1))).otherwise(F.lower(F.coalesce(F.try_element_at(tokens, F.lit(-1)), strip(c))))


def answer(dataset: Column, c: Column) -> Column:
    """The short answer of a response, by dataset: payload or last token, yes or no, or the whole text; '' for null."""
    text, name = strip(F.coalesce(c, F.lit(""))), F.coalesce(dataset, F.lit(""))
    return F.when(text == "", "").when(name.startswith("vlmbias"), last_token(text)).when(name == "pope_adversarial", yes_no(text)).otherwise(F.lower(text))


def is_correct(dataset: Column, response: Column, gold: Column) -> Column:
    """By dataset: payload equal to or holding the gold, first of yes and no, text holding it, or plain equality. An empty gold is
    held by any text."""
    want, said = canonical(gold), canonical(response)
    payload = F.when(response.rlike(BRACED), canonical(F.regexp_extract(response, BRACED, 1))).otherwise(said)
    return (
        F.when(dataset.startswith("vlmbias"), F.contains(payload, want))
        .when(dataset == "pope_adversarial", yes_no(said).isin("yes", "no") & (yes_no(said) == want))
        .when(dataset == "mathvista_mini", F.contains(said, want))
        .otherwise(said == want)
    )


def loose(c: Column) -> Column:
    """Strip, lower, closing punctuation off, then white space collapsed, in this order: ' 5 .' is '5 '."""
    return F.regexp_replace(F.regexp_replace(canonical(c), r"[.!?,;:]+$", ""), r"(?U)\s+", " ")


def verifies(text: Column, gold: Column) -> Column:
    """Whether a response holds the gold answer: a choice letter, a closing number, or equal or contained text; never if either is
    empty."""
    said, want = (loose(F.when(F.coalesce(boxed(x), F.lit("")) != "", boxed(x)).otherwise(x)) for x in (text, gold))
    letters = [F.lower(F.regexp_extract(F.replace(x, F.lit(" "), F.lit("")), CHOICE_LETTER, 1)) for x in (said, want)]
    numbers = [F.regexp_extract(x, TRAILING_NUMBER, 1) for x in (said, want)]
    return (
        F.when((said == "") | (want == ""), False)
        .when((letters[0] != "") & (letters[1] != ""), letters[0] == letters[1])
        .when((numbers[0] != "") & (numbers[1] != ""), numbers[0].try_cast("double") == numbers[1].try_cast("double"))
        .otherwise(F.contains(said, want))
    )


def last_integer(c: Column) -> Column:
    """Integer in the box, else the last one there, else the last one in the text; null if there is none."""

    def last(x: Column) -> Column:
        return F.try_element_at(F.regexp_extract_all(x, F.lit(INTEGER), F.lit(0)), F.lit(-1)).try_cast("bigint")

    box = strip(F.regexp_extract(c, FLAT_BOX, 1))
    return F.coalesce(box.try_cast("bigint"), last(box), last(c))


def image_id(c: Column) -> Column:
    """Closing digits of an image's file name, else the whole value as an integer, else null."""
    return F.coalesce(F.regexp_extract(c, IMAGE_NAME, 1).try_cast("bigint"), c.try_cast("bigint"))


def gold_response(gold: Column) -> Column:
    return F.concat(F.lit("Final answer: \\boxed{"), gold, F.lit("}."))


def choice_parsed(text: Column, choices: Column) -> Column:
    """Whether a response names a choice or a letter A to E as a word (the article 'a' counts)."""
    named = F.exists(choices, lambda x: (x != "") & F.contains(F.lower(text), F.lower(x)))
    return F.coalesce(named, F.lit(False)) | text.rlike(r"(?U)\b[A-Ea-e]\b")


def templated(template: str, *parts: Column) -> Column:
    return F.format_string(template, *parts)


def joined_id(*parts: Column) -> Column:
    """Parts joined by '_'; md5 of them where a part is null."""
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.concat_ws("_", *parts)).otherwise(F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])))


def fixed(c: Column, digits: int = 3) -> Column:
    """A number as text with so many digits, a dash for null."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def log_entries(line: Column) -> Column:
    """Array of (metric, value) of a log line's numbered keys; words such as True are no values, nan and inf are."""
    keys, values = (F.regexp_extract_all(line, F.lit(LOG_PAIR), F.lit(i)) for i in (1, 2))
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("metric"), v.try_cast("double").alias("value")))


def log_step(line: Column) -> Column:
    return F.regexp_extract(line, LOG_STEP, 1).try_cast("bigint")
