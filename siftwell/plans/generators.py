"""Questions with known answers by topic: a table function that is joined laterally to the rows that ask for them.

Each draw is a hash of (seed, index, what is drawn), so a question depends on nothing but these: not on the partition, the order of rows
or how many questions are asked for. Images are drawn elsewhere, from the facts in extras.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Draw = Callable[[str, int], int]  # (what, n): a number below n
Made = tuple[str, str, dict]  # question, gold, facts

# Topics, questions, ranges and shares that answers must keep to.
GRID_SHAPES = ("circle", "square", "triangle", "star", "diamond")
LEGS = {"quadruped": 4, "biped": 2, "hexapod": 6, "octopod": 8}
MOST_LEGS = 10
PIECES = (("P", 50), ("N", 15), ("B", 15), ("R", 15), ("Q", 5))
QUESTIONS = {
    "grid_rows": "How many rows are in the grid?",
    "grid_cols": "How many columns are in the grid?",
    "grid_total": "How many {}s are in the grid?",
    "stars": "How many stars are on the flag?",
    "stripes": "How many stripes does this flag have?",
    "board_rows": "How many rows does this game board have?",
    "board_cols": "How many columns does this game board have?",
    "dark": "How many dark colored squares are on the board?",
    "total_white": "How many white pieces are on the board?",
    "total_black": "How many black pieces are on the board?",
    "pawns_white": "How many white pawns are on the board?",
    "pawns_black": "How many black pawns are on the board?",
    "legs": "How many legs does the creature in the image have?",
}


def patterned_grid(draw: Draw) -> Made:
    rows, cols, shape = 3 + draw("rows", 8), 3 + draw("cols", 8), GRID_SHAPES[draw("shape", 5)]
    variant = ("rows", "cols", "total")[draw("variant", 3)]
    answer = {"rows": rows, "cols": cols, "total": rows * cols}[variant]
    return QUESTIONS[f"grid_{variant}"].format(shape), str(answer), {"q_variant": variant, "rows": rows, "cols": cols, "shape_type": shape}


def flag(draw: Draw) -> Made:
    canton = draw("canton", 2) == 0
    stripes, stars = 3 + draw("stripes", 11), 1 + draw("stars", 25) if canton else 0
    variant = "stars" if canton and draw("variant", 10) < 6 else "stripes"
    return QUESTIONS[variant], str(stars if variant == "stars" else stripes), {"q_variant": variant, "n_stripes": stripes, "has_canton": canton, "n_stars": stars}


def game_board(draw: Draw) -> Made:
    size = 3 + draw("size", 10)
    variant, dark = ("rows", "cols", "dark")[draw("variant", 3)], size * size // 2  # the light squares have the corners
    question = QUESTIONS["dark" if variant == "dark" else f"board_{variant}"]
    return question, str(dark if variant == "dark" else size), {"q_variant": variant, "n_size": size, "dark_count": dark}


def chess_position(draw: Draw) -> Made:
    """A king and other pieces by their weights on each side; a side's pawns are asked for if it has some, or by the toss of a coin."""
    facts, choices = {}, []
    for side in ("white", "black"):
        n = 2 + draw(side, 15)
        pawns = sum(draw(f"{side}{i}", 100) < PIECES[0][1] for i in range(1, n))
        facts |= {f"n_{side}": n, f"n_{side}_pawns": pawns}
        choices.append((f"total_{side}", n))
    for side in ("white", "black"):
        if facts[f"n_{side}_pawns"] or draw(f"ask_{side}", 2) == 0:
            choices.append((f"pawns_{side}", facts[f"n_{side}_pawns"]))
    variant, answer = choices[draw("variant", len(choices))]
    return QUESTIONS[variant], str(answer), {"q_variant": variant, **facts}


def animal(draw: Draw) -> Made:
    """Three in ten have the legs of their kind, the others any other number."""
    kind = list(LEGS)[draw("kind", len(LEGS))]
    usual = draw("usual", 10) < 3
    other = draw("legs", MOST_LEGS)
    legs = LEGS[kind] if usual else other + (other >= LEGS[kind])
    return QUESTIONS["legs"], str(legs), {"q_variant": "legs", "body_type": kind, "canonical_legs": LEGS[kind], "n_legs": legs, "is_counterfactual": not usual}


GENERATORS: dict[str, Callable[[Draw], Made]] = {f.__name__: f for f in (patterned_grid, flag, game_board, chess_position, animal)}


def drawer(seed: int, idx: int) -> Draw:
    return lambda what, n: int.from_bytes(hashlib.md5(f"{seed}:{idx}:{what}".encode()).digest()[:4], "big") % n


@F.udtf(returnType="idx bigint, question string, gold string, extras string", useArrow=True)
class Questions:
    """(topic, seed, n): n questions of a topic, numbered from 0. A null count or topic gives none, an unknown topic raises."""

    def eval(self, topic: str, seed: int, n: int) -> Iterator[tuple]:
        if topic is None or n is None:
            return
        if topic not in GENERATORS:
            raise KeyError(f"{topic} is none of {sorted(GENERATORS)}")
        for idx in range(n):
            question, gold, facts = GENERATORS[topic](drawer(seed or 0, idx))
            yield idx, question, gold, json.dumps({"topic": topic} | facts)


def ask(rows: DataFrame, topic: str = "topic", seed: str = "seed", n: str = "n") -> DataFrame:
    """rows with n questions each (idx, question, gold, extras as JSON text): columns name a row's topic, seed and number of questions."""
    given = (F.col(topic).outer(), F.col(seed).cast("bigint").outer(), F.col(n).cast("bigint").outer())
    return rows.lateralJoin(Questions(*given))
