"""Extraction of transactions from statement text behind one interface, with retries.

An extractor takes (card, text) and returns the reply's JSON text. Engines that call a service plug in
here; the one that comes with the package reads delimited lines and needs no network.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.constants import CATEGORIES, INSTRUCTION, TRANSACTION_KEYS

Extractor = Callable[[str, str], str]
LINE = re.compile(r"^\s*(\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{2})[\t|,]\s*(.+?)\s*[\t|,]\s*(-?[\d,]+)\s*원?\s*(?:[\t|]\s*(\S+))?\s*$")
MAX_CHARS, ATTEMPTS = 15_000, 3


def line_extractor(card: str, text: str) -> str:
    """Lines of day, merchant, amount and, optionally, category."""
    day_of = lambda d: d if "-" in d else "20" + d.replace(".", "-")
    rows = [dict(zip(TRANSACTION_KEYS, (day_of(m[1]), m[2], int(m[3].replace(",", "")), m[4] or CATEGORIES[-1]))) for line in text[:MAX_CHARS].splitlines() if (m := LINE.match(line))]
    return json.dumps({"transactions": rows}, ensure_ascii=False)


def prompt(card: str) -> str:
    """What an engine is asked about a card's statement: the rules of what counts, and the categories to choose from."""
    return INSTRUCTION.format(card=card, categories=", ".join(CATEGORIES))


def well_formed(reply: str) -> bool:
    try:
        rows = json.loads(reply)["transactions"]
    except (ValueError, KeyError, TypeError):
        return False
    day, merchant, amount, category = TRANSACTION_KEYS
    return isinstance(rows, list) and all(isinstance(r, dict) and all(isinstance(r.get(k), str) for k in (day, merchant, category)) and isinstance(r.get(amount), (int, float)) and not isinstance(r.get(amount), bool) for r in rows)


def with_retry(engine: Extractor, card: str, text: str, attempts: int = ATTEMPTS) -> str:
    """The first well-formed reply of at most `attempts`; otherwise an error."""
    last = ""
    for _ in range(attempts):
        last = engine(card, text)
        if well_formed(last):
            return last
    raise ValueError(f"no well-formed reply in {attempts} attempts: {last[:80]}")


def statement_head(text: Column) -> Column:
    """What of a statement goes to an engine: its first MAX_CHARS characters."""
    return F.substring(text, 1, MAX_CHARS)


def extract(files: DataFrame, engine: Extractor = line_extractor) -> DataFrame:
    """(card, filename, text) to (card, filename, json, error): a file that fails does not fail the others."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for card, filename, text in zip(batch["card"], batch["filename"], batch["text"]):
                try:
                    rows.append((card, filename, with_retry(engine, card, text or ""), None))
                except Exception as e:  # kept with the file, for the next run
                    rows.append((card, filename, None, str(e)))
            yield pd.DataFrame(rows, columns=["card", "filename", "json", "error"])

    return files.select("card", "filename", statement_head(F.col("text")).alias("text")).mapInPandas(run, "card string, filename string, json string, error string")


def process(files: DataFrame, root: str, engine: Extractor = line_extractor, batch_id: int = 0) -> DataFrame:
    """One call from statement texts to the ledger: what was added and skipped per month."""
    from lodestar.storage import written
    from lodestar.streaming.ledger_stream import update

    replies = written(extract(files, engine), "extracted")
    update(replies.where("json IS NOT NULL"), root, batch_id)
    return files.sparkSession.read.parquet(f"{root}/counts").where(F.col("batch_id") == batch_id)
