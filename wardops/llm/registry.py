"""The queries of this package and their SQL."""

from __future__ import annotations

from . import importance, language, lines, mixing, neighbours, pii, quality, sharding, simhash, spelling, substrings, winnowing, wrappers

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_sharding": sharding.op2_sharding,
    "op3_lines": lines.op3_lines,
    "op4_language": language.op4_language,
    "op5_substrings": substrings.op5_substrings,
    "op6_simhash": simhash.op6_simhash,
    "op7_pii": pii.op7_pii,
    "op8_winnowing": winnowing.op8_winnowing,
    "op9_quality": quality.op9_quality,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_importance": importance.op12_importance,
    "op13_wrappers": wrappers.op13_wrappers,
}

SQL = {
    "op1_neighbours": neighbours.op1_sql(),
    "op2_sharding": sharding.op2_sql(),
    "op3_lines": lines.op3_sql(),
    "op5_substrings": substrings.op5_sql(),
    "op8_winnowing": winnowing.op8_sql(),
    "op11_spelling": spelling.op11_sql(),
    "op12_importance": importance.op12_sql(),
}
