"""Column functions on text; all native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# User-agent classes: the first rule with a token in the text wins. Tokens rather than patterns,
# and in the case agents write them, since every row pays for each test.
DEVICE_RULES = [
    (("iPad", "Tablet", "Kindle", "Silk/"), "Tablet"),
    (("iPhone", "iPod", "Windows Phone", "BlackBerry", "Mobile"), "Smartphone"),
    (("Android",), "Tablet"),
    (("SmartTV", "SMART-TV", "HbbTV", "AppleTV", "Roku"), "Smart TV"),
    (("PlayStation", "Xbox", "Nintendo"), "Game console"),
    (("Windows NT", "Macintosh", "X11", "CrOS"), "Personal computer"),
]
OS_RULES = [
    (("Windows Phone",), "Windows Phone"),
    (("Windows",), "Windows"),
    (("iPhone", "iPad", "iPod"), "iOS"),
    (("Mac OS X", "Macintosh"), "OS X"),
    (("Android",), "Android"),
    (("CrOS",), "Chrome OS"),
    (("Linux", "X11"), "Linux"),
]
BROWSER_RULES = [
    (("Edge/", "Edg/", "EdgA/", "EdgiOS/"), "Edge"),
    (("OPR/", "Opera"), "Opera"),
    (("SamsungBrowser/",), "Samsung Browser"),
    (("Firefox/", "FxiOS/"), "Firefox"),
    (("MSIE ", "Trident/"), "IE"),
    (("Chrome/", "CriOS/"), "Chrome"),
    (("Safari/",), "Safari"),
]


def filled(value: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(value, F.lit(""))


def first_filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[filled(v) for v in values], F.lit(""))


def category_default(value: Column, default: str, unknown_is_missing: bool = False) -> Column:
    """``default`` for null and empty text, and on demand for "unknown" in any case."""
    missing = value.isNull() | (value == "")
    if unknown_is_missing:
        missing = missing | (F.lower(value) == "unknown")
    return F.when(missing, F.lit(default)).otherwise(value)


def _first_rule(agent: Column, rules: Sequence[tuple[tuple[str, ...], str]], default: str | None) -> Column:
    # the labels are known, so what counts as missing is settled here and the rules are tested once
    result = F.lit(default).cast("string")
    for tokens, label in reversed(rules):
        named = default if default is not None and label.lower() in ("", "unknown") else label
        result = F.when(reduce(or_, [agent.contains(t) for t in tokens]), named).otherwise(result)
    return result


def device_class(agent: Column, default: str | None = None) -> Column:
    """Device class of a user agent; ``default`` if no rule fits or the class is unknown."""
    return _first_rule(agent, DEVICE_RULES, default)


def os_class(agent: Column, default: str | None = None) -> Column:
    return _first_rule(agent, OS_RULES, default)


def browser_class(agent: Column, default: str | None = None) -> Column:
    return _first_rule(agent, BROWSER_RULES, default)


def clean_name(value: Column) -> Column:
    """Keep ASCII letters, digits, underscore and hyphen."""
    return F.regexp_replace(value, "[^A-Za-z0-9_-]", "")


def dotted_tail(value: Column) -> Column:
    """Last segment of a dotted name."""
    return F.element_at(F.split(value, r"\."), -1)


# The time variables a path template may name and the word each becomes.
DAY_WORDS = {"yesterday_ds_nodash": "Yesterday", "ds_nodash": "Today"}


def path_label(template: Column, drop: Sequence[str] = ()) -> Column:
    """Readable label of a dated path template such as ``s3://b/x/{{ ds_nodash }}/_SUCCESS``.

    ``drop`` lists literals to remove from the path. A template with another time variable gives
    null.
    """
    path = F.split_part(F.split_part(template, F.lit("{{"), F.lit(1)), F.lit("//"), F.lit(2))
    for literal in drop:
        path = F.replace(path, F.lit(literal), F.lit(""))
    path = F.regexp_replace(path, "/+$", "")
    path = F.lower(F.translate(path, "/ ", "-_"))
    variable = F.trim(
        F.split_part(F.split_part(template, F.lit("{{"), F.lit(2)), F.lit("}}"), F.lit(1))
    )
    word = F.lit(None).cast("string")
    for name, day in DAY_WORDS.items():
        word = F.when(variable == name, day).otherwise(word)
    return F.concat(word, F.lit(" "), path, F.lit(" available"))


def hex_shard(key: Column, other: str = "s") -> Column:
    """Shard of a key: its first character if that is a lower-case hex digit, else ``other``."""
    digit = F.substring(key, 1, 1)
    return F.when(digit.rlike("^[0-9a-f]$"), digit).otherwise(other)
