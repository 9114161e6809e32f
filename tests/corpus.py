"""Twelve articles about animals and five about phones, as category and summary rows."""

import hashlib

ANIMALS = (
    "cats dogs whales lions owls bees wolves frogs eagles foxes bears seals".split()
)
PHONES = "battery camera screen antenna charger".split()


def key(link: str) -> str:
    return hashlib.shake_256(link.encode()).hexdigest(16)


def articles() -> list[dict]:
    rows = []
    for number, topic in enumerate(ANIMALS + PHONES):
        animal = topic in ANIMALS
        link = f"https://example.com/story/{number}-{topic}"
        kind = "animal zoo wild nature" if animal else "phone device technology market"
        tags = [topic, "wildlife" if animal else "technology"]
        if topic in ("lions", "bears"):
            tags.append("zoo")
        rows.append(
            {
                "link": link,
                "link_hash": key(link),
                "headline": f"A story about {topic}",
                "date": f"2018-03-{number + 1:02d}",
                "summarization": f"{kind} {topic} {kind} in short",
                "tags": tags,
                "key_insights": [f"The {topic} matter.", f"More about {topic} follows."],
            }
        )
    return rows


def category_rows(spark, rows=None):
    rows = articles() if rows is None else rows
    data = [(i, r["link"], r["link_hash"], r["headline"], r["date"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(
        data, "line bigint, link string, link_hash string, headline string, date string"
    )


def summary_rows(spark, rows=None):
    rows = articles() if rows is None else rows
    data = [
        (i, r["link_hash"], r["summarization"], r["tags"], r["key_insights"]) for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        data,
        "line bigint, link_hash string, summarization string, tags array<string>, key_insights array<string>",
    )
