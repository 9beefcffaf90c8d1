"""Porter's stemmer as DuckDB SQL, for the statements that text queries are checked against.

It shares the fixed suffix tables with ``functions.analysis`` and nothing else: a word's shape is a string of C and V
(consonants and vowels), and all conditions are patterns over it.
"""

from __future__ import annotations

from skeinwork.functions import analysis as an


def shape(w: str) -> str:
    """C or V for each letter; a y is a vowel behind a consonant, else a consonant."""
    x = f"regexp_replace(regexp_replace(regexp_replace({w}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g'), '^y', 'C')"
    for _ in range(3):
        x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
    return x


def over(w: str, n: int) -> str:
    """The measure is over n."""
    return f"regexp_matches({shape(w)}, '{'V+C+' * n}V+C')"


def short_end(w: str) -> str:
    return f"({shape(w)} = 'VC' OR regexp_matches({shape(w)}, 'CVC$') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"


def cut(w: str, n: int | str) -> str:
    return f"left({w}, length({w}) - {n})"


def _cases(rules: dict[str, str]) -> str:
    return "CASE s " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"


def _longest(rules) -> str:
    """The longest suffix of the rules: the leftmost match that reaches the end."""
    return f"regexp_extract(w, '({'|'.join(rules)})$')"


def steps(vocabulary: str) -> dict[str, str]:
    """Table expressions from ``vocabulary(term)`` to ``stems(term, stem)``."""
    irregular = f"CASE term {' '.join(f'''WHEN '{a}' THEN '{b}' ''' for a, b in an._IRREGULAR.items())} ELSE NULL END"
    a = f"""CASE WHEN w LIKE '%ies' AND length(w) = 4 THEN {cut("w", 1)} WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {cut("w", 2)}
        WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN {cut("w", 1)} ELSE w END"""
    b = f"""CASE WHEN w LIKE '%ied' THEN left(w, length(w) - CASE WHEN length(w) = 4 THEN 1 ELSE 2 END)
        WHEN w LIKE '%eed' THEN CASE WHEN {over(cut("w", 3), 0)} THEN {cut("w", 1)} ELSE w END
        WHEN w LIKE '%ed' AND contains({shape(cut("w", 2))}, 'V') THEN {cut("w", 2)} || '+'
        WHEN w LIKE '%ing' AND contains({shape(cut("w", 3))}, 'V') THEN {cut("w", 3)} || '+' ELSE w END"""
    x = cut("w", 1)  # without the mark of a removed suffix
    b2 = f"""CASE WHEN w NOT LIKE '%+' THEN w WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e'
        WHEN length({x}) > 1 AND right({x}, 1) = left(right({x}, 2), 1) AND right({shape(x)}, 1) = 'C' THEN CASE WHEN right({x}, 1) IN ('l', 's', 'z') THEN
          CASE WHEN {over(x, 0)} AND NOT {over(x, 1)} AND {short_end(x)} THEN {x} || 'e' ELSE {x} END ELSE {cut("w", 2)} END
        WHEN {over(x, 0)} AND NOT {over(x, 1)} AND {short_end(x)} THEN {x} || 'e' ELSE {x} END"""
    c = f"CASE WHEN w LIKE '%y' AND length(w) > 2 AND right({shape(cut('w', 1))}, 1) = 'C' THEN {cut('w', 1)} || 'i' ELSE w END"
    d = f"CASE WHEN w LIKE '%alli' AND {over(cut('w', 4), 0)} THEN {cut('w', 2)} ELSE w END"
    stem = "left(w, length(w) - length(s))"
    change = lambda rules, tested: f"CASE WHEN s <> '' AND {over(tested, 0)} THEN {stem} || {_cases(rules)} ELSE w END"
    f = f"CASE WHEN s <> '' AND {over(stem, 1)} AND (s <> 'ion' OR regexp_matches({stem}, '[st]$')) THEN {stem} ELSE w END"
    g = f"CASE WHEN w LIKE '%e' AND ({over(cut('w', 1), 1)} OR {over(cut('w', 1), 0)} AND NOT {short_end(cut('w', 1))}) THEN {cut('w', 1)} ELSE w END"
    h = f"CASE WHEN w LIKE '%ll' AND {over(cut('w', 1), 1)} THEN {cut('w', 1)} ELSE w END"
    chain, last = {"stem0": f"SELECT term, term AS w FROM ({vocabulary}) WHERE length(term) > 2 AND {irregular} IS NULL"}, "stem0"
    for i, (w, s) in enumerate(
        [(a, ""), (b, ""), (b2, ""), (c, ""), (d, ""), (change(an._STEP2, f"{stem} || CASE s WHEN 'logi' THEN 'l' ELSE '' END"), _longest(an._STEP2)), (change(an._STEP3, stem), _longest(an._STEP3)), (f, _longest(an._STEP4)), (g, ""), (h, "")], 1
    ):
        source = f"(SELECT term, w, {s} AS s FROM {last})" if s else last
        chain[f"stem{i}"] = f"SELECT term, {w} AS w FROM {source}"
        last = f"stem{i}"
    chain["stems"] = f"SELECT term, w AS stem FROM {last} UNION ALL SELECT term, coalesce({irregular}, term) FROM ({vocabulary}) WHERE length(term) <= 2 OR {irregular} IS NOT NULL"
    return chain
