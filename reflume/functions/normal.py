"""The normal distribution's tails as SQL text that Spark and DuckDB read alike."""

from __future__ import annotations


def two_sided(z: str) -> str:
    """The chance of a standard normal farther from 0 than the double expression z >= 0: a series below 2.5 standard deviations times root 2, a continued fraction beyond."""
    x = f"({z} * 7.071067811865476e-1)"
    series, fraction = "1e0", x
    for n in range(60, 0, -1):
        series = f"(1e0 + 2e0 * {x} * {x} / {2 * n + 1}e0 * {series})"
    for n in range(50, 0, -1):
        fraction = f"({x} + {n * 5}e-1 / {fraction})"
    return f"(CASE WHEN {x} < 2.5e0 THEN 1e0 - 1.1283791670955126e0 * {x} * exp(-{x} * {x}) * {series} ELSE exp(-{x} * {x}) * 5.641895835477563e-1 / {fraction} END)"
