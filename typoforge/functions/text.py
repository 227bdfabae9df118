"""String expressions over columns named by SQL text, so that each can stand in any plan without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_of_glob(glob: str) -> str:
    """SQL of a LIKE pattern (ESCAPE '!') for a column with globs: only * is special."""
    return f"replace(replace(replace(replace({glob}, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%')"


def glob_match(text: str, glob: str) -> Column:
    return F.expr(f"{text} LIKE {like_of_glob(glob)} ESCAPE '!'")


def marker_core(pattern: str) -> Column:
    """A pattern without its leading and trailing ':'; a lone ':' is both and leaves nothing."""
    return F.expr(f"CASE WHEN {pattern} = ':' THEN '' ELSE substring({pattern}, 1 + int(startswith({pattern}, ':')), greatest(length({pattern}) - int(startswith({pattern}, ':')) - int(endswith({pattern}, ':')), 0)) END")


def marker_boundary(pattern: str) -> Column:
    return F.expr(f"CASE WHEN startswith({pattern}, ':') AND endswith({pattern}, ':') THEN 'both' WHEN startswith({pattern}, ':') THEN 'left' WHEN endswith({pattern}, ':') THEN 'right' END")


def boundary_display(boundary: str) -> Column:
    return F.expr(f"CASE WHEN {boundary} = 'none' THEN '' ELSE concat('(', upper({boundary}), ' boundary)') END")


def qmk_text(typo: str, boundary: str) -> Column:
    return F.expr(f"concat(CASE WHEN {boundary} IN ('left', 'both') THEN ':' ELSE '' END, {typo}, CASE WHEN {boundary} IN ('right', 'both') THEN ':' ELSE '' END)")


def replace_first(long: str, short: str, by: str) -> Column:
    """The first occurrence of ``short`` in ``long`` replaced; null if there is none."""
    return F.expr(f"CASE WHEN instr({long}, {short}) > 0 THEN concat(substring({long}, 1, instr({long}, {short}) - 1), {by}, substring({long}, instr({long}, {short}) + length({short}))) END")


def last_place(long: str, short: str) -> str:
    """SQL of the 1-based place of the last occurrence; 0 or under if there is none."""
    return f"(CASE WHEN instr({long}, {short}) = 0 THEN 0 ELSE length({long}) - length({short}) - instr(reverse({long}), reverse({short})) + 2 END)"


def replace_last(long: str, short: str, by: str) -> Column:
    at = last_place(long, short)
    return F.expr(f"CASE WHEN {at} > 0 THEN concat(substring({long}, 1, {at} - 1), {by}, substring({long}, {at} + length({short}))) END")


def suffix_guard(typo: str, word: str) -> Column:
    """The typo is a likely inflection of its word."""
    plain = " OR ".join(f"{typo} = concat({word}, '{s}')" for s in ("s", "ed", "er", "or"))
    return F.expr(f"({plain} OR ({word} LIKE '%e' AND {typo} IN (concat({word}, 'd'), concat({word}, 'r'))) OR ({word} LIKE '%o' AND {typo} = concat({word}, 'r')))")


def target_relation(typo: str, word: str) -> Column:
    """Where the typo stands in its word: struct(prefix, suffix, middle)."""
    return F.expr(f"named_struct('prefix', {typo} <> {word} AND startswith({word}, {typo}), 'suffix', {typo} <> {word} AND endswith({word}, {typo}), 'middle', length({word}) > length({typo}) + 1 AND contains(substring({word}, 2, length({word}) - 2), {typo}))")


def letter_of(word: str) -> Column:
    return F.expr(f"CASE WHEN lower(substring({word}, 1, 1)) RLIKE '^[a-z]$' THEN lower(substring({word}, 1, 1)) ELSE 'symbols' END")
