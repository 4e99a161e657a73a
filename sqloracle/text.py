"""SQL fragments: stop list, word extraction, Porter stemmer CTE chain (DuckDB dialect)."""

from __future__ import annotations

from sqloracle import fixed as S
from sqloracle.fixed import STOP_WORDS, WHITESPACE_CLASS

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words_of(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9]+')"


def keep_word(col: str) -> str:
    return f"(length({col}) > 1 AND {col} NOT IN {STOP_SQL})"


def collapse_ws(col: str) -> str:
    return f"trim(regexp_replace({col}, {q(WHITESPACE_CLASS + '+')}, ' ', 'g'))"


def trim_ws(col: str) -> str:
    return f"regexp_replace({col}, {q('^' + WHITESPACE_CLASS + '+|' + WHITESPACE_CLASS + '+$')}, '', 'g')"


def _cut(w: str, n: str) -> str:
    return f"left({w}, length({w}) - ({n}))"


def _suffix_case(w: str, suffixes, extra: str = "") -> str:
    whens = " ".join(
        f"WHEN suffix({w}, {q(s)}) AND length({w}) > {len(s)} THEN {q(s)}"
        for s in sorted(suffixes, key=len, reverse=True)
    )
    return f"CASE {whens} {extra} ELSE NULL END"


def _repl_case(sfx: str, table: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {sfx} {whens} END"


def stem_ctes(src: str, out: str) -> str:
    """CTE list turning relation ``src(word)`` into ``out(word, term)``; append after WITH ... ,"""
    gt0, gt1, eq1 = q(S.MEASURE_GT0), q(S.MEASURE_GT1), q(S.MEASURE_EQ1)
    hasv, cvc = q(S.HAS_VOWEL), q(S.ENDS_CVC)
    p = out + "_s"
    ctes = []
    ctes.append(f"{p}0 AS (SELECT word, CASE WHEN starts_with(word, 'y') THEN 'Y' || substr(word, 2) "
                f"ELSE word END AS w FROM {src})")
    ctes.append(
        f"{p}1 AS (SELECT word, CASE WHEN (suffix(w, 'sses') AND length(w) > 4) OR (suffix(w, 'ies') AND "
        f"length(w) > 3) THEN {_cut('w', '2')} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') AND length(w) > 2 "
        f"THEN {_cut('w', '1')} ELSE w END AS w FROM {p}0)"
    )
    eed = "(suffix(w, 'eed') AND length(w) > 3)"
    ed = f"(suffix(w, 'ed') AND length(w) > 2 AND regexp_matches({_cut('w', '2')}, {hasv}))"
    ing = f"(suffix(w, 'ing') AND length(w) > 3 AND regexp_matches({_cut('w', '3')}, {hasv}))"
    ctes.append(
        f"{p}2 AS (SELECT word, CASE WHEN {eed} THEN (CASE WHEN regexp_matches({_cut('w', '3')}, {gt0}) "
        f"THEN {_cut('w', '1')} ELSE w END) WHEN {ed} THEN {_cut('w', '2')} WHEN {ing} THEN {_cut('w', '3')} "
        f"ELSE w END AS w, (NOT {eed}) AND ({ed} OR {ing}) AS fix FROM {p}1)"
    )
    ctes.append(
        f"{p}3 AS (SELECT word, CASE WHEN NOT fix THEN w "
        f"WHEN suffix(w, 'at') OR suffix(w, 'bl') OR suffix(w, 'iz') THEN w || 'e' "
        f"WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) "
        f"AND NOT regexp_matches(right(w, 1), '[aeiouylsz]') THEN {_cut('w', '1')} "
        f"WHEN regexp_matches(w, {cvc}) THEN w || 'e' ELSE w END AS w FROM {p}2)"
    )
    ctes.append(
        f"{p}4 AS (SELECT word, CASE WHEN suffix(w, 'y') AND length(w) > 1 AND "
        f"regexp_matches({_cut('w', '1')}, {hasv}) THEN {_cut('w', '1')} || 'i' ELSE w END AS w FROM {p}3)"
    )
    ctes.append(f"{p}5 AS (SELECT word, w, {_suffix_case('w', S.STEP2)} AS sfx FROM {p}4)")
    ctes.append(
        f"{p}6 AS (SELECT word, CASE WHEN sfx IS NOT NULL AND regexp_matches({_cut('w', 'length(sfx)')}, {gt0}) "
        f"THEN {_cut('w', 'length(sfx)')} || {_repl_case('sfx', S.STEP2)} ELSE w END AS w FROM {p}5)"
    )
    ctes.append(f"{p}7 AS (SELECT word, w, {_suffix_case('w', S.STEP3)} AS sfx FROM {p}6)")
    ctes.append(
        f"{p}8 AS (SELECT word, CASE WHEN sfx IS NOT NULL AND regexp_matches({_cut('w', 'length(sfx)')}, {gt0}) "
        f"THEN {_cut('w', 'length(sfx)')} || {_repl_case('sfx', S.STEP3)} ELSE w END AS w FROM {p}7)"
    )
    ion = "WHEN (suffix(w, 'sion') OR suffix(w, 'tion')) AND length(w) > 4 THEN 'ion'"
    ctes.append(f"{p}9 AS (SELECT word, w, {_suffix_case('w', S.STEP4, ion)} AS sfx FROM {p}8)")
    ctes.append(
        f"{p}10 AS (SELECT word, CASE WHEN sfx IS NOT NULL AND regexp_matches({_cut('w', 'length(sfx)')}, {gt1}) "
        f"THEN {_cut('w', 'length(sfx)')} ELSE w END AS w FROM {p}9)"
    )
    st = _cut("w", "1")
    ctes.append(
        f"{p}11 AS (SELECT word, CASE WHEN suffix(w, 'e') AND length(w) > 1 AND (regexp_matches({st}, {gt1}) OR "
        f"(regexp_matches({st}, {eq1}) AND NOT regexp_matches({st}, {cvc}))) THEN {st} ELSE w END AS w FROM {p}10)"
    )
    ctes.append(
        f"{p}12 AS (SELECT word, CASE WHEN suffix(w, 'll') AND regexp_matches(w, {gt1}) THEN {st} ELSE w END AS w "
        f"FROM {p}11)"
    )
    ctes.append(
        f"{out} AS (SELECT word, CASE WHEN length(word) < 3 THEN word WHEN starts_with(w, 'Y') THEN "
        f"'y' || substr(w, 2) ELSE w END AS term FROM {p}12)"
    )
    return ",\n".join(ctes)
