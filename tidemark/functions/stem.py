"""Porter stemmer (T3) as built-in Spark expressions.

The algorithm is Porter's 1980 suffix stripper in its widely used released form: words under three
letters are kept, an initial ``y`` counts as a consonant, step 2 maps ``bli`` to ``ble`` and ``logi`` to
``log``. Each step's result is bound once as a lambda variable (``transform(array(x), step)[0]``), so the
expression grows linearly with the number of steps and the whole stemmer is one projection. All tests are
suffix checks (``endswith``), ``left`` cuts and anchored regexes for the measure.

Use it on the distinct vocabulary when that is much smaller than the token stream: the cost is per distinct word, not per token.
``stem_word`` is the same stemmer for one word in a Python worker, where the index build keeps the stems of the words it has seen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Porter's consonant / vowel runs and the measure conditions on a stem.
CONS = "[^aeiou][^aeiouy]*"
VOWS = "[aeiouy][aeiou]*"
MEASURE_GT0 = f"^({CONS})?{VOWS}{CONS}"
MEASURE_GT1 = f"^({CONS})?({VOWS}{CONS}){{2,}}"
MEASURE_EQ1 = f"^({CONS})?{VOWS}{CONS}({VOWS})?$"
HAS_VOWEL = f"^({CONS})?[aeiouy]"
ENDS_CVC = f"^{CONS}[aeiouy][^aeiouwxy]$"
NO_DOUBLE = "[aeiouylsz]"

# Step 2 suffix -> replacement (condition m > 0).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
# Step 3 suffix -> replacement (condition m > 0).
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# Step 4 suffixes removed when m > 1; "ion" is removed after s or t.
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment",
         "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

def _cut(w: Column, n) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.left(w, F.length(w) - n)


def _longest_suffix(w: Column, suffixes) -> Column:
    """The longest listed suffix that leaves a non-empty stem, or null."""
    expr = None
    for s in sorted(suffixes, key=len, reverse=True):
        cond = w.endswith(s) & (F.length(w) > len(s))
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    return expr


def _step1a(w: Column) -> Column:
    n = F.length(w)
    return (
        F.when((w.endswith("sses") & (n > 4)) | (w.endswith("ies") & (n > 3)), _cut(w, 2))
        .when(w.endswith("s") & ~w.endswith("ss") & (n > 2), _cut(w, 1))
        .otherwise(w)
    )


def _step1b_strip(w: Column):
    n = F.length(w)
    eed = w.endswith("eed") & (n > 3)
    ed = w.endswith("ed") & (n > 2) & _cut(w, 2).rlike(HAS_VOWEL)
    ing = w.endswith("ing") & (n > 3) & _cut(w, 3).rlike(HAS_VOWEL)
    new = (
        F.when(eed, F.when(_cut(w, 3).rlike(MEASURE_GT0), _cut(w, 1)).otherwise(w))
        .when(ed, _cut(w, 2))
        .when(ing, _cut(w, 3))
        .otherwise(w)
    )
    return new, (~eed & (ed | ing))


def _step1b_fix(w: Column, flag: Column) -> Column:
    last = F.substring(w, -1, 1)
    double = (F.length(w) > 1) & (last == F.substring(w, -2, 1)) & ~last.rlike(NO_DOUBLE)
    fixed = (
        F.when(w.endswith("at") | w.endswith("bl") | w.endswith("iz"), F.concat(w, F.lit("e")))
        .when(double, _cut(w, 1))
        .when(w.rlike(ENDS_CVC), F.concat(w, F.lit("e")))
        .otherwise(w)
    )
    return F.when(flag, fixed).otherwise(w)


def _step1c(w: Column) -> Column:
    stem = _cut(w, 1)
    cond = w.endswith("y") & (F.length(w) > 1) & stem.rlike(HAS_VOWEL)
    return F.when(cond, F.concat(stem, F.lit("i"))).otherwise(w)


def _replace_step(w: Column, sfx: Column, table: dict) -> Column:
    stem = _cut(w, F.length(sfx))
    repl = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[sfx]
    return F.when(sfx.isNotNull() & stem.rlike(MEASURE_GT0), F.concat(stem, repl)).otherwise(w)


def _step4_suffix(w: Column) -> Column:
    ion = (w.endswith("sion") | w.endswith("tion")) & (F.length(w) > 4)
    return _longest_suffix(w, STEP4).when(ion, F.lit("ion"))


def _step4(w: Column, sfx: Column) -> Column:
    stem = _cut(w, F.length(sfx))
    return F.when(sfx.isNotNull() & stem.rlike(MEASURE_GT1), stem).otherwise(w)


def _step5a(w: Column) -> Column:
    stem = _cut(w, 1)
    keep_e = stem.rlike(MEASURE_GT1) | (stem.rlike(MEASURE_EQ1) & ~stem.rlike(ENDS_CVC))
    return F.when(w.endswith("e") & (F.length(w) > 1) & keep_e, stem).otherwise(w)


def _step5b(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_GT1), _cut(w, 1)).otherwise(w)


def _bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable (keeps the tree linear)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _step1b(x: Column) -> Column:
    new, flag = _step1b_strip(x)
    return _bind(F.struct(new.alias("w"), flag.alias("f")), lambda s: _step1b_fix(s["w"], s["f"]))


def _suffix_step(table: dict):
    return lambda x: _bind(_longest_suffix(x, table), lambda sfx: _replace_step(x, sfx, table))


def stem(word: Column) -> Column:
    """Porter stem of a lower-case word (T3), as one expression."""
    w = _bind(
        F.when(word.startswith("y"), F.concat(F.lit("Y"), F.substr(word, F.lit(2)))).otherwise(word), _step1a
    )
    w = _bind(w, _step1b)
    w = _bind(w, _step1c)
    w = _bind(w, _suffix_step(STEP2))
    w = _bind(w, _suffix_step(STEP3))
    w = _bind(w, lambda x: _bind(_step4_suffix(x), lambda sfx: _step4(x, sfx)))
    w = _bind(w, _step5a)
    w = _bind(w, _step5b)
    restored = _bind(w, lambda x: F.when(x.startswith("Y"), F.concat(F.lit("y"), F.substr(x, F.lit(2)))).otherwise(x))
    return F.when(F.length(word) < 3, word).otherwise(restored)


_BUILT: dict = {}


def stem_of(name: str) -> Column:
    """``stem(col(name))``, built once per Spark context (the expression is large and always the same)."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    hit = _BUILT.get(name)
    if hit is None or hit[0] is not sc:
        hit = _BUILT[name] = (sc, stem(F.col(name)))
    return hit[1]


def add_stem(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Append column ``dst`` = Porter stem of the lower-case word in ``src``."""
    return df.withColumn(dst, stem_of(src))


_GT0, _GT1, _EQ1, _VOWEL, _CVC = (re.compile(p) for p in (MEASURE_GT0, MEASURE_GT1, MEASURE_EQ1, HAS_VOWEL, ENDS_CVC))
_STEP4 = frozenset(STEP4)
_LENGTHS = {id(t): sorted({len(s) for s in t}, reverse=True) for t in (STEP2, STEP3, _STEP4)}


def _suffix_of(w: str, suffixes) -> str | None:
    for n in _LENGTHS[id(suffixes)]:
        if n < len(w) and w[-n:] in suffixes:
            return w[-n:]
    return None


def stem_word(word: str) -> str:
    """Porter stem of one lower-case ASCII word, equal to ``stem``."""
    if len(word) < 3:
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):  # step 1a
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 2:
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:  # step 1b
        w = w[:-1] if _GT0.match(w[:-3]) else w
    else:
        cut = 2 if w.endswith("ed") and len(w) > 2 and _VOWEL.match(w[:-2]) else 3 if w.endswith("ing") and len(w) > 3 and _VOWEL.match(w[:-3]) else 0
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in NO_DOUBLE[1:-1]:
                w = w[:-1]
            elif _CVC.match(w):
                w += "e"
    if w.endswith("y") and len(w) > 1 and _VOWEL.match(w[:-1]):  # step 1c
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        suffix = _suffix_of(w, table)
        if suffix and _GT0.match(w[:-len(suffix)]):
            w = w[:-len(suffix)] + table[suffix]
    suffix = _suffix_of(w, _STEP4) or ("ion" if w.endswith(("sion", "tion")) and len(w) > 4 else None)
    if suffix and _GT1.match(w[:-len(suffix)]):
        w = w[:-len(suffix)]
    if w.endswith("e") and len(w) > 1:  # step 5a
        rest = w[:-1]
        w = rest if _GT1.match(rest) or (_EQ1.match(rest) and not _CVC.match(rest)) else w
    if w.endswith("ll") and _GT1.match(w):  # step 5b
        w = w[:-1]
    return "y" + w[1:] if w.startswith("Y") else w
