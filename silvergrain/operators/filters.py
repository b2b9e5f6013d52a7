"""Hard filters over images: a small syntax tree compiled to predicates and semi joins.

Filters never rank. They are combined by AND; a filter that looks into another table becomes
a semi or anti join, so nothing is joined that no filter asks for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TUNING

#: Tables that filters look into, by name: paths(image, volume, root, rel_path, active),
#: ratings(image, rating), stats(image, has_strokes), events(image, ts, source) of live content,
#: members(collection, image, removed_ts), volumes(volume, name, online), roots(root, name, active).
Tables = Mapping[str, DataFrame]


class Filter:
    """Restricts images (image, capture_ts, camera, lens)."""

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        raise NotImplementedError


def _semi(images: DataFrame, found: DataFrame, how: str = "left_semi") -> DataFrame:
    return images.join(found.select("image"), "image", how)


@dataclass(frozen=True)
class Captured(Filter):
    """Capture time in [start, end); images without one never match."""

    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        return images.where(in_range("capture_ts", self.start, self.end))


@dataclass(frozen=True)
class Annotated(Filter):
    """A live content event in [start, end)."""

    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        return _semi(images, tables["events"].where(in_range("ts", self.start, self.end)))


@dataclass(frozen=True)
class Gear(Filter):
    """Camera or lens, equal or (``contains``) holding the text; ASCII case is ignored."""

    field: str
    value: str
    contains: bool = False

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        mine, asked = F.lower(self.field), F.lower(F.lit(self.value))
        return images.where(mine.contains(asked) if self.contains else mine == asked)


@dataclass(frozen=True)
class Subtree(Filter):
    """An active path below a folder; the empty folder means any active path."""

    folder: str

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        paths, prefix = tables["paths"].where("active"), self.folder.strip("/").lower()
        return _semi(images, paths.where(F.lower("rel_path").startswith(prefix + "/")) if prefix else paths)


@dataclass(frozen=True)
class FolderContains(Filter):
    """An active path whose folders, not the file name, hold the text."""

    part: str

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        return _semi(images, tables["paths"].where(F.col("active") & F.lower(F.regexp_extract("rel_path", "^(.*/)", 1)).contains(self.part.lower())))


@dataclass(frozen=True)
class Root(Filter):
    """An active path in an active root of that name."""

    name: str

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        roots = tables["roots"].where(F.col("active") & (F.col("name") == self.name)).select("root")
        return _semi(images, tables["paths"].where("active").join(roots, "root", "left_semi"))


@dataclass(frozen=True)
class Rating(Filter):
    """A current rating from ``low`` to ``high``, either way round; unrated images never match."""

    low: int | None = None
    high: int | None = None

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        low, high = self.low, self.high
        if low is not None and high is not None and low > high:
            low, high = high, low
        return _semi(images, tables["ratings"].where(in_range("rating", low, None) & (F.lit(True) if high is None else F.col("rating") <= high)))


@dataclass(frozen=True)
class HasStrokes(Filter):
    """With strokes, or without; images without statistics have none."""

    wanted: bool = True

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        return _semi(images, tables["stats"].where("has_strokes"), "left_semi" if self.wanted else "left_anti")


@dataclass(frozen=True)
class Source(Filter):
    """A live content event of one of the sources; no sources admit nothing."""

    sources: tuple[str, ...]

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        return _semi(images, tables["events"].where(F.col("source").isin(*self.sources))) if self.sources else images.where(F.lit(False))


@dataclass(frozen=True)
class Volume(Filter):
    """``online``, ``offline`` (not online), or the name of a volume with an active path."""

    state: str

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        at = tables["paths"].where("active").join(tables["volumes"], "volume")
        if self.state in ("online", "offline"):
            return _semi(images, at.where("online"), "left_semi" if self.state == "online" else "left_anti")
        return _semi(images, at.where(F.col("name") == self.state))


@dataclass(frozen=True)
class Collection(Filter):
    """Current members of a collection (by its key)."""

    collection: object

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        if self.collection is None:
            raise ValueError("the collection's name is not known")
        return _semi(images, tables["members"].where((F.col("collection") == self.collection) & F.col("removed_ts").isNull()))


@dataclass(frozen=True)
class Kind(Filter):
    """Declared in the syntax, but no search runs it."""

    kind: str

    def apply(self, images: DataFrame, tables: Tables) -> DataFrame:
        raise ValueError("filters by kind can't be run")


def in_range(column: str, start: object, end: object) -> Column:
    """``column`` in [start, end); null never."""
    c = F.col(column)
    out = c.isNotNull()
    if start is not None:
        out = out & (c >= F.lit(start))
    if end is not None:
        out = out & (c < F.lit(end))
    return out


def admit(images: DataFrame, filters: Sequence[Filter], tables: Tables) -> DataFrame:
    """Images that pass all filters."""
    for f in filters:
        images = f.apply(images, tables)
    return images


def browse(images: DataFrame, filters: Sequence[Filter], tables: Tables, limit: int = TUNING.browse_limit) -> DataFrame:
    """Admitted images, newest capture first, undated last."""
    return admit(images, filters, tables).orderBy(F.col("capture_ts").desc_nulls_last(), "image").limit(limit)


# ---------------------------------------------------------------- relative dates


def last_days(now: dt.datetime, n: int) -> tuple[dt.datetime, None]:
    return now - dt.timedelta(days=n), None


def last_weeks(now: dt.datetime, n: int) -> tuple[dt.datetime, None]:
    return last_days(now, 7 * n)


def last_months(now: dt.datetime, n: int) -> tuple[dt.datetime, None]:
    """``n`` civil months back; the day is cut to the month's length."""
    months = now.year * 12 + now.month - 1 - n
    year, month = divmod(months, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    return now.replace(year=year, month=month + 1, day=min(now.day, (following - dt.timedelta(days=1)).day)), None


def last_years(now: dt.datetime, n: int) -> tuple[dt.datetime, None]:
    return last_months(now, 12 * n)


#: The first month of each season; winter begins in December of its year.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}


def season(now: dt.datetime, name: str, years_ago: int = 0) -> tuple[dt.datetime, dt.datetime]:
    year, first = now.year - years_ago, SEASONS[name]
    end = dt.datetime(year + (first == 12), (first + 2) % 12 + 1, 1)
    return dt.datetime(year, first, 1), end


def month(now: dt.datetime, number: int, year: int | None = None) -> tuple[dt.datetime, dt.datetime]:
    """A month; without a year its last occurrence."""
    y = year if year is not None else now.year - (number > now.month)
    return dt.datetime(y, number, 1), dt.datetime(y + (number == 12), number % 12 + 1, 1)


def whole_year(year: int) -> tuple[dt.datetime, dt.datetime]:
    return dt.datetime(year, 1, 1), dt.datetime(year + 1, 1, 1)


# ---------------------------------------------------------------- clauses


def clauses(raw: Sequence[Mapping], now: dt.datetime, cameras: Sequence[str] = (), lenses: Sequence[str] = (), sources: Sequence[str] = ("typed", "voice", "pencil")) -> tuple[list[Filter], list[Mapping]]:
    """Clauses from an untrusted parser: (filters of the good ones, the dropped ones)."""
    good, dropped = [], []
    known = {"camera": {c.lower() for c in cameras}, "lens": {x.lower() for x in lenses}}
    for c in raw:
        try:
            kind = c["type"]
            if kind in ("camera", "lens"):
                if str(c["value"]).lower() not in known[kind]:
                    raise ValueError(c["value"])
                good.append(Gear(kind, str(c["value"])))
            elif kind == "rating":
                low, high = (None if c.get(k) is None else int(c[k]) for k in ("low", "high"))
                if any(x is not None and not 0 <= x <= 5 for x in (low, high)) or low is high is None:
                    raise ValueError(c)
                good.append(Rating(low, high))
            elif kind == "season":
                good.append(Captured(*season(now, c["name"], int(c.get("years_ago", 0)))))
            elif kind in ("last_days", "last_weeks", "last_months", "last_years"):
                good.append(Captured(*{"last_days": last_days, "last_weeks": last_weeks, "last_months": last_months, "last_years": last_years}[kind](now, int(c["n"]))))
            elif kind == "month":
                good.append(Captured(*month(now, int(c["number"]), c.get("year"))))
            elif kind == "year":
                good.append(Captured(*whole_year(int(c["year"]))))
            elif kind == "folder":
                good.append(Subtree(str(c["value"])))
            elif kind == "strokes":
                good.append(HasStrokes(bool(c["value"])))
            elif kind == "source":
                if not set(c["values"]) <= set(sources):
                    raise ValueError(c)
                good.append(Source(tuple(c["values"])))
            elif kind == "volume":
                good.append(Volume(str(c["value"])))
            else:
                raise ValueError(kind)
        except (KeyError, TypeError, ValueError, AttributeError):
            dropped.append(c)
    return good, dropped


def vocabulary(images: DataFrame, field: str, limit: int = 40) -> DataFrame:
    """The field's values by frequency, then value: what a parser is told."""
    return images.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def children(paths: DataFrame, folder: str) -> DataFrame:
    """Active paths directly in a folder."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring(F.col("rel_path"), len(prefix) + 1, 1 << 30)
    return paths.where(F.col("active") & F.col("rel_path").startswith(prefix) & ~rest.contains("/"))


def folder_rows(paths: DataFrame, images: DataFrame, stats: DataFrame, volumes: DataFrame, previews: DataFrame) -> DataFrame:
    """What a folder's list shows of each image."""
    out = paths.where("active").join(images, "image").join(stats, "image", "left").join(volumes.select("volume", "online"), "volume", "left").join(previews.select("image").distinct().withColumn("__p", F.lit(True)), "image", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("image", "rel_path", "capture_ts", (yes("has_text") | yes("has_strokes")).alias("has_journal"), (~yes("online")).alias("offline"), yes("__p").alias("has_preview"))
