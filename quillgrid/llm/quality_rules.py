"""Quality rules: base counts and the divergence of a text's distributions
from language references, in one pass of column expressions.

Two histograms of a text are held against each language's reference by
Jensen-Shannon distance (base 2, so between 0 and 1): shares of character
classes, and shares of the language's ten most common words among all words.
The nearest language counts. Texts below a guard length are not judged by a
histogram that so few items cannot fill. The references are of four languages in
Latin letters: a text in which more than ``other_script`` of the characters are
outside ASCII (prose in other scripts, where those of the four have a tenth at
most) has no reference and is kept or refused by the base rules alone.

Nothing is shuffled, nothing depends on other rows. A null text is an empty
text: zero words, fails the base rule. A long text is taken whole, in arrays of its
words and windows. Rows keep their multiplicity; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import pick, split_words

BLANKS = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"

#: Character classes, as regex classes. Blanks, characters outside
#: ASCII and, as the rest, lower-case letters, digits and odd signs make the other
#: three. (Digits alone don't tell a bad text: one account number in a short one
#: is a tenth of it.)
CLASSES = {"upper": "A-Z", "point": r".,;:!?'\x22()\-", "symbol": SYMBOLS}
#: Shares in running prose of upper, point, symbol, blank,
#: outside ASCII, rest.
CLASS_SHARES = {
    "en": (0.015, 0.018, 0.000, 0.165, 0.000, 0.802),
    "fr": (0.012, 0.018, 0.000, 0.165, 0.063, 0.742),
    "de": (0.030, 0.018, 0.000, 0.145, 0.025, 0.782),
    "es": (0.012, 0.018, 0.000, 0.165, 0.038, 0.767),
}
#: The commonest words and their shares in running prose.
WORD_SHARES = {
    "en": {"the": 0.062, "of": 0.032, "and": 0.028, "to": 0.026, "in": 0.021, "a": 0.021, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.010},
    "fr": {"de": 0.050, "la": 0.028, "et": 0.022, "le": 0.022, "les": 0.019, "des": 0.017, "en": 0.015, "un": 0.012, "une": 0.010, "que": 0.010},
    "de": {"die": 0.036, "der": 0.035, "und": 0.029, "in": 0.018, "den": 0.013, "zu": 0.011, "das": 0.011, "mit": 0.009, "von": 0.009, "sich": 0.008},
    "es": {"de": 0.062, "la": 0.040, "que": 0.031, "el": 0.029, "en": 0.028, "y": 0.027, "los": 0.018, "se": 0.012, "las": 0.011, "un": 0.011},
}


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdict. The distances are in [0, 1]."""

    min_words: int = 50
    max_repeat_percent: int = 50
    class_distance: float = 0.19
    class_guard_chars: int = 200
    word_distance: float = 0.29
    word_guard_words: int = 200
    other_script: float = 0.35


def js_distance(p: list[Column], q: list[float]) -> Column:
    """Jensen-Shannon distance of the shares ``p`` from the constants ``q``."""
    parts = []
    for a, b in zip(p, q, strict=True):
        m = (a + F.lit(b)) / 2
        parts.append(F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0)))
        if b > 0:
            parts.append(F.lit(b) * F.log2(F.lit(b) / m))
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def removed(text: Column, cls: str, total: Column) -> Column:
    """How many characters of ``text`` are in the regex class."""
    return (total - F.char_length(F.regexp_replace(text, f"[{cls}]+", ""))).cast("long")


def forms(word: str) -> list[str]:
    """How a common word stands in a text: plain or capitalised, bare or before a comma or stop."""
    return [w + end for w in (word, word.capitalize()) for end in ("", ",", ".")]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Per row: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance.

    Equal 3-word windows are found by sorting their hashes (64 and 32 bits); neighbours
    with the same are compared as words.
    """
    t, common = F.col("_text"), sorted({w for words in WORD_SHARES.values() for w in words})
    every_form = ", ".join(f"'{f}'" for w in common for f in forms(w))
    df = pick(docs, id_col, text_col).withColumns({
        "_words": split_words(t, BLANKS),
        "_n": F.char_length(t).cast("long"),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        # each 3-word window's hash with its place, equal windows side by side
        "_sorted": F.expr("""IF(size(_words) < 3, array(), sort_array(transform(sequence(0, size(_words) - 3),
            i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) AS h, hash(_words[i], _words[i + 1], _words[i + 2]) AS g, i AS i))))"""),
        # the common words alone, each between two blanks of its own: occurrences are then counted by replacement
        "_common": F.expr(f"concat(' ', lower(regexp_replace(array_join(filter(_words, x -> x IN ({every_form})), '  '), '[,.]', '')), ' ')"),
    })
    df = df.withColumn(
        "_repeated",
        # the places of each window and the equal one before it
        F.expr("""filter(transform(_sorted, (x, k) -> IF( k > 0 AND _sorted[greatest(k - 1, 0)].h = x.h AND _words[_sorted[k - 1].i] = _words[x.i]
            AND _words[_sorted[k - 1].i + 1] = _words[x.i + 1] AND _words[_sorted[k - 1].i + 2] = _words[x.i + 2],
            array(x.i, x.i + 1, x.i + 2, _sorted[k - 1].i, _sorted[k - 1].i + 1, _sorted[k - 1].i + 2), NULL)), a -> a IS NOT NULL)"""),
    )
    df = df.withColumns({
        "n_repeat_words": F.size(F.array_distinct(F.flatten("_repeated"))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        **{f"_c_{k}": removed(t, cls, F.col("_n")) for k, cls in CLASSES.items()},
        "_c_blank": F.col("_n") - F.col("word_chars"),
        "_c_wide": F.when(F.octet_length(t) > F.col("_n"), removed(t, r"^\x00-\x7F", F.col("_n"))).otherwise(F.lit(0).cast("long")),
        **{f"_w_{w}": (F.octet_length("_common") - F.octet_length(F.replace("_common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in common},
    })
    chars, words = F.greatest(F.col("_n"), F.lit(1)).cast("double"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    seen = [F.col(f"_c_{k}") for k in (*CLASSES, "blank", "wide")]
    # blanks are ASCII, so no character is in two classes
    shares = [c / chars for c in (*seen, F.col("_n") - sum(seen[1:], seen[0]))]
    by_class = [js_distance(shares, list(q)) for q in CLASS_SHARES.values()]
    by_word = []
    for q in WORD_SHARES.values():
        p = [F.col(f"_w_{w}") / words for w in q]
        by_word.append(js_distance([*p, F.greatest(1 - sum(p[1:], p[0]), F.lit(0.0))], [*q.values(), 1 - sum(q.values())]))
    df = df.withColumns({"class_distance": F.least(*by_class), "word_distance": F.least(*by_word)})
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    near = ((F.col("_n") < rules.class_guard_chars) | (F.col("class_distance") <= rules.class_distance)) & (
        (F.col("n_words") < rules.word_guard_words) | (F.col("word_distance") <= rules.word_distance)
    )
    near = near | (F.col("_c_wide") > rules.other_script * F.col("_n"))
    return df.select(
        F.col("_id").alias(id_col), "n_words", "word_chars",
        F.col("_c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near).alias("kept"), "class_distance", "word_distance",
    )
