"""Made-up rows: from providers, from a fitted distribution, and for related tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from greenframe.functions import fixed_values as fixed
from greenframe.functions import wordlists as words
from greenframe.functions.numeric import (
    hashed_uniform,
    literal_array,
    normal_cdfs,
    normal_quantiles,
)
from greenframe.operators.moments import pair_moments
from greenframe.operators.ordered import epoch_micros
from greenframe.operators.profile import (
    INTEGRAL,
    TEMPORAL,
    describe_numeric,
    describe_text,
    kind,
    present,
    quoted,
)
from greenframe.session import checkpointed

# ---- providers --------------------------------------------------------------


class _Fake:
    """Values of one column, each a function of (row id, column name, seed)."""

    def __init__(self, row: Column, column: str, locale: str, seed: int):
        self.row, self.column, self.locale, self.seed = row, column, locale, seed

    def below(self, size: int, salt: str) -> Column:
        return F.pmod(F.xxhash64(self.row, F.lit(self.column), F.lit(salt), F.lit(self.seed)), F.lit(size))

    def pick(self, choices: list[str], salt: str) -> Column:
        return F.get(F.array(*[F.lit(c) for c in choices]), self.below(len(choices), salt).cast("int"))

    def local(self, choices: dict[str, list[str]], salt: str) -> Column:
        return self.pick(choices[self.locale], salt)

    def digits(self, count: int, salt: str) -> Column:
        return F.lpad(self.below(10**count, salt).cast("string"), count, "0")

    def hexes(self, count: int, salt: str) -> Column:
        return F.lower(F.lpad(F.hex(self.below(16**count, salt)), count, "0"))

    def some_words(self, count: int, salt: str) -> Column:
        listed = F.array(*[F.lit(w) for w in words.WORD])
        each = F.transform(
            F.sequence(F.lit(1), F.lit(count)),
            lambda i: F.get(listed, F.pmod(F.xxhash64(self.row, F.lit(self.column), F.lit(salt), F.lit(self.seed), i), F.lit(len(words.WORD))).cast("int")),
        )
        return F.array_join(each, " ")

    def sentence(self, salt: str) -> Column:
        text = self.some_words(6, salt)
        return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)), F.lit("."))

    def name(self) -> Column:
        first, last = self.local(words.FIRST, "first"), self.local(words.LAST, "last")
        if self.locale in ("ja_JP", "zh_CN"):
            return F.concat(last, F.lit(" " if self.locale == "ja_JP" else ""), first)
        return F.concat_ws(" ", first, last)

    def login(self) -> Column:
        return F.concat(self.pick(words.LOGIN, "login"), self.digits(4, "login number"))

    def domain(self) -> Column:
        return F.concat(self.pick(words.LOGIN, "host"), F.lit("."), self.pick(words.DOMAIN, "domain"))

    def street(self) -> Column:
        return F.format_string(words.STREET[self.locale], self.below(200, "house") + 1, self.local(words.LAST, "street"))

    def moment(self) -> Column:
        """1970-01-01 up to 2024-12-31."""
        return F.timestamp_seconds(self.below(1_735_689_600, "moment")).cast("timestamp")

    def card(self) -> Column:
        """Sixteen digits with a valid check digit."""
        body = F.concat(F.lit("4"), self.digits(14, "card"))
        # every second digit from the right of the body counts double
        def weight(i):
            digit = F.substr(body, i, F.lit(1)).cast("int")
            double = digit * 2
            return F.when(i % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(digit)

        total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(15)), weight), F.lit(0), lambda a, b: a + b)
        return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))

    def bban(self) -> Column:
        return F.concat(self.digits(9, "bank"), self.digits(9, "account"))

    def iban(self) -> Column:
        """Country code, two check digits (mod 97), bank and account."""
        country = self.locale[-2:]
        numeric = "".join(str(ord(letter) - 55) for letter in country)
        rest = F.concat(self.bban(), F.lit(numeric + "00")).cast("decimal(38,0)") % F.lit(97).cast("decimal(38,0)")
        return F.concat(F.lit(country), F.lpad((98 - rest).cast("int").cast("string"), 2, "0"), self.bban())

    def value(self, provider: str) -> Column:
        address = lambda: F.concat_ws(", ", self.street(), self.digits(5, "zip"), self.local(words.CITY, "city"))
        made = {
            "name": self.name,
            "first_name": lambda: self.local(words.FIRST, "first"),
            "last_name": lambda: self.local(words.LAST, "last"),
            "prefix": lambda: self.local(words.PREFIX, "prefix"),
            "suffix": lambda: self.pick(words.SUFFIX, "suffix"),
            "email": lambda: F.concat(self.login(), F.lit("@"), self.pick(words.DOMAIN, "domain")),
            "phone_number": lambda: F.concat(F.lit(f"+{words.DIAL[self.locale]}"), (self.below(9, "lead") + 1).cast("string"), self.digits(8, "phone")),
            "address": address,
            "street_address": self.street,
            "city": lambda: self.local(words.CITY, "city"),
            "state": lambda: self.local(words.STATE, "state"),
            "zipcode": lambda: self.digits(5, "zip"),
            "country": lambda: self.pick(words.COUNTRY, "country"),
            "url": lambda: F.concat(F.lit("https://www."), self.domain(), F.lit("/")),
            "domain_name": self.domain,
            "ipv4": lambda: F.concat_ws(".", *[self.below(256, f"octet {i}").cast("string") for i in range(4)]),
            "ipv6": lambda: F.concat_ws(":", *[self.hexes(4, f"group {i}") for i in range(8)]),
            "mac_address": lambda: F.concat_ws(":", *[self.hexes(2, f"pair {i}") for i in range(6)]),
            "user_name": self.login,
            "company": lambda: F.concat_ws(" ", self.local(words.LAST, "company"), self.pick(words.COMPANY_END, "form")),
            "job": lambda: self.pick(words.JOB, "job"),
            "catch_phrase": lambda: F.concat_ws(" ", self.pick(words.QUALITY, "a"), self.pick(words.MANNER, "b"), self.pick(words.THING, "c")),
            "bs": lambda: F.concat_ws(" ", self.pick(words.DOING, "a"), self.pick(words.MANNER, "b"), self.pick(words.THING, "c")),
            "credit_card_number": self.card,
            "credit_card_provider": lambda: self.pick(words.CARD, "card maker"),
            "iban": self.iban,
            "bban": self.bban,
            "date": lambda: F.date_format(self.moment(), "yyyy-MM-dd"),
            "date_time": self.moment,
            "time": lambda: F.date_format(self.moment(), "HH:mm:ss"),
            "year": lambda: F.date_format(self.moment(), "yyyy"),
            "text": lambda: F.concat_ws(" ", *[self.sentence(f"line {i}") for i in range(5)]),
            "sentence": lambda: self.sentence("line"),
            "paragraph": lambda: F.concat_ws(" ", *[self.sentence(f"line {i}") for i in range(3)]),
            "word": lambda: self.some_words(1, "word"),
            "random_int": lambda: self.below(10_000, "int").cast("int"),
            "random_number": lambda: self.below(10**9, "number"),
            "pyfloat": lambda: (hashed_uniform(self.row, F.lit(self.column), F.lit(self.seed)) - 0.5) * 2e6,
        }
        return made[provider]()


PROVIDERS = [name for group in fixed.FAKE_PROVIDERS.values() for name in group]


def generate_fake(spark: SparkSession, rows: int, columns: list[tuple[str, str]], locale: str = "en_US",
                  seed: int = 42) -> DataFrame:
    """``rows`` made-up rows of (name, provider) columns; equal arguments give equal rows on any cluster."""
    if rows <= 0:
        raise ValueError("rows must be positive")
    if not columns:
        raise ValueError("no columns")
    names = [name for name, _ in columns]
    if len(set(names)) != len(names):
        raise ValueError("column names repeat")
    unknown = [provider for _, provider in columns if provider not in PROVIDERS]
    if unknown:
        raise ValueError(f"unknown providers: {unknown}")
    if locale not in fixed.LOCALES:
        raise ValueError(f"unknown locale {locale!r}")
    return spark.range(rows).select(
        *[_Fake(F.col("id"), name, locale, seed).value(provider).alias(name) for name, provider in columns]
    )


def replace_personal(df: DataFrame, key: str, columns: dict[str, str], locale: str = "en_US", seed: int = 42) -> DataFrame:
    """``df`` with made-up values in ``columns`` (name -> provider); other columns and missing cells stay.

    A value depends on ``key``, the column and ``seed`` only, so rows of one key, in any table, get the same one.
    """
    unknown = sorted({p for p in columns.values() if p not in PROVIDERS} | {c for c in columns if c not in df.columns})
    if unknown:
        raise ValueError(f"unknown providers or columns: {unknown}")
    if locale not in fixed.LOCALES:
        raise ValueError(f"unknown locale {locale!r}")
    row = F.xxhash64(quoted(key))
    made = {c: _Fake(row, c, locale, seed).value(p).cast(df.schema[c].dataType) for c, p in columns.items()}
    return df.select(*[F.when(quoted(c).isNotNull(), made[c]).alias(c) if c in made else quoted(c) for c in df.columns])


# ---- Gaussian copula --------------------------------------------------------

KNOTS = 400
MOST_DIGITS = 6
#: Parts of the values that are equally frequent, so that numbering them is not one task's.
VALUE_PARTS = 64
#: Categories, and characters of all of them, that go to all tasks; beyond either, rows meet them by a shuffle.
MOST_SENT, MOST_CHARS = 10_000, 2_000_000


@dataclass
class Shares:
    """The categories of a column as a table (value, from, n): each takes the ranks from ``from`` to before ``from + n``."""

    table: DataFrame
    values: int
    total: int
    chars: int = 0

    def sent(self, table: DataFrame) -> DataFrame:
        """How ``table``, a few rows per category, is joined. Never by sending the rows: how many there are is not in Spark's estimates."""
        small = self.values <= MOST_SENT and self.chars <= MOST_CHARS
        return F.broadcast(table) if small else table.hint("merge")

    @property
    def width(self) -> int:
        """Ranks of a slot: there are about as many slots as categories, so a rank meets two or three on average."""
        return max(1, self.total // self.values)

    def rank(self, u: Column) -> Column:
        return F.least(F.floor(u * F.lit(float(self.total))).cast("long"), F.lit(self.total - 1))

    def at(self, rows: DataFrame, rank: str, name: str) -> DataFrame:
        """Add ``name``: the category whose share holds ``rank``. An equality join on the slot; every rank has one category."""
        slots = self.table.select(
            F.col("value").alias(name), F.col("from").alias("_from"), F.col("n").alias("_n"),
            F.explode(F.sequence(F.expr(f"`from` div {self.width}L"), F.expr(f"(`from` + n - 1) div {self.width}L"))).alias("_slot_of"),
        )
        inside = (F.col("_slot") == F.col("_slot_of")) & (F.col(rank) >= F.col("_from")) & (F.col(rank) < F.col("_from") + F.col("_n"))
        return rows.withColumn("_slot", F.expr(f"{rank} div {self.width}L")).join(self.sent(slots), inside).drop("_slot", "_slot_of", "_from", "_n", rank)

    def middles(self) -> DataFrame:
        """(value, middle): the middle of each category's share."""
        return self.sent(self.table.select("value", ((F.col("from") + F.col("n") / 2) / self.total).alias("middle")))


@dataclass
class Margin:
    """One column: a quantile grid of a number or moment, category shares, or neither (a surrogate text)."""

    name: str
    data_type: T.DataType
    missing: float
    knots: list[float] = field(default_factory=list)
    digits: int | None = None
    shares: Shares | None = None

    @property
    def linked(self) -> bool:
        return bool(self.knots or self.shares)


@dataclass
class Copula:
    """Margins and the Cholesky factor of the normal scores' correlation; only the tables of categories grow with the data."""

    margins: list[Margin]
    factor: list[list[float]]
    rows: int


def _number(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, TEMPORAL):
        return epoch_micros(df, name).cast("double")
    return present(df, name).cast("double")


def _decimals(value: Column) -> Column:
    """Decimal places of a number; more than MOST_DIGITS count as one too many."""
    found = F.when(F.rint(value) == value, 0)
    for d in range(1, MOST_DIGITS + 1):
        found = found.when(F.rint(value * 10.0**d) / 10.0**d == value, d)
    return F.when(value.isNotNull(), found.otherwise(MOST_DIGITS + 1))


def _as_text(df: DataFrame, name: str) -> Column:
    return F.hex(quoted(name)) if isinstance(df.schema[name].dataType, T.BinaryType) else quoted(name).cast("string")


def _shares(df: DataFrame, columns: list[str]) -> dict[str, Shares]:
    """The shares of all values of all ``columns`` but those in which no value repeats: these have identifiers, not categories.

    All columns are counted in one scan. The commonest value comes first; values of one frequency are numbered within
    parts, and the sums before each (frequency, part) are all that passes from one to the next.
    """
    if not columns:
        return {}
    texts = df.select(*[_as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = texts.unpivot([], texts.columns, "c", "value").filter(F.col("value").isNotNull())
    counts = checkpointed(cells.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n")))
    sizes = {r["c"]: r for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("total"), F.sum(F.length("value")).alias("chars")).collect()}
    parts = counts.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(VALUE_PARTS)))
    sums = parts.groupBy("c", "n", "part").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("c").orderBy(F.desc("n"), "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("c", "n", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("c", "n", "part").orderBy("value")) - 1
    placed = parts.withColumn("nth", nth).join(sums, ["c", "n", "part"])
    placed = checkpointed(placed.select("c", "value", (F.col("before") + F.col("nth") * F.col("n")).alias("from"), "n"))
    return {
        c: Shares(placed.filter(F.col("c") == f"c{i}").drop("c"), *(sizes[f"c{i}"][k] for k in ("values", "total", "chars")))
        for i, c in enumerate(columns)
        if f"c{i}" in sizes and (sizes[f"c{i}"]["values"] < sizes[f"c{i}"]["total"] or sizes[f"c{i}"]["total"] == 1)
    }


def _margins(df: DataFrame, columns: list[str]) -> tuple[list[Margin], int]:
    numeric = [c for c in columns if kind(df.schema[c].dataType) in ("numeric", "datetime")]
    listed = [c for c in columns if c not in numeric]
    grid = F.array(*[F.lit(i / KNOTS) for i in range(KNOTS + 1)])
    fractions = [c for c in numeric if not isinstance(df.schema[c].dataType, (*INTEGRAL, *TEMPORAL))]
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(present(df, c).isNull()).alias(f"missing_{c}") for c in columns],
        *[F.percentile_approx(_number(df, c), grid, KNOTS * 25).alias(f"grid_{c}") for c in numeric],
        *[F.struct(F.min(_number(df, c)), F.max(_number(df, c))).alias(f"ends_{c}") for c in numeric],
        *[F.max(_decimals(_number(df, c))).alias(f"digits_{c}") for c in fractions],
    ).first()
    rows, shares = stats["rows"], _shares(df, listed)
    margins = []
    for c in columns:
        margin = Margin(c, df.schema[c].dataType, stats[f"missing_{c}"] / rows if rows else 0.0, shares=shares.get(c))
        if c in numeric and stats[f"grid_{c}"]:
            low, high = stats[f"ends_{c}"]
            margin.knots = [low, *stats[f"grid_{c}"][1:-1], high]
            if c in fractions:
                margin.digits = stats[f"digits_{c}"] if stats[f"digits_{c}"] <= MOST_DIGITS else None
        margins.append(margin)
    return margins, rows


def _places(df: DataFrame, linked: list[Margin]) -> DataFrame:
    """Per cell ``x<i>`` the number, or the middle of a value's share where it repeats; null where it is missing."""
    values = df.select(*[(_number(df, m.name) if m.knots else _as_text(df, m.name)).alias(f"x{i}") for i, m in enumerate(linked)])
    for i, m in enumerate(linked):
        if m.shares:
            middles = m.shares.middles().select(F.col("value").alias("_value"), F.col("middle").alias("_middle"))
            values = values.join(middles, F.col(f"x{i}") == F.col("_value"), "left").withColumn(f"x{i}", F.col("_middle")).drop("_value", "_middle")
    return values.select(*[f"x{i}" for i in range(len(linked))])


def _on_grid(value: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """The position of each number on the grid, from 0 to 1; one that equals knots takes their middle."""
    last = len(knots) - 1
    left = np.searchsorted(knots, value, "left")
    after = np.minimum(left, last)
    equal = knots[after] == value
    before = np.maximum(left - 1, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = before + (value - knots[before]) / (knots[after] - knots[before])
    at = np.where(left == 0, 0.0, np.where(left > last, last, at))
    at[equal] = (left[equal] + np.searchsorted(knots, value[equal], "right") - 1) / 2.0
    return np.where(np.isnan(value), np.nan, at / max(1, last))


def _scoring(linked: list[Margin]) -> Callable[[np.ndarray], np.ndarray]:
    """Normal scores of rows of _places() under their margins, NaN where a cell is missing."""
    grids = [np.array(m.knots) if m.knots else None for m in linked]

    def scores(rows: np.ndarray) -> np.ndarray:
        placed = [rows[:, i] if knots is None else _on_grid(rows[:, i], knots) for i, knots in enumerate(grids)]
        return normal_quantiles(np.clip(np.column_stack(placed), 1e-6, 1 - 1e-6))

    return scores


def fit_copula(df: DataFrame, columns: list[str] | None = None) -> Copula:
    """Learn margins and correlation in two scans (and one small count per text column)."""
    margins, rows = _margins(df, columns or df.columns)
    linked = [m for m in margins if m.linked]
    d = len(linked)
    matrix = np.eye(d)
    if d > 1 and rows:
        found = pair_moments(_places(df, linked), [0.0] * d, _scoring(linked)).correlation()
        matrix = np.where(np.isnan(found), np.eye(d), found)
        values, vectors = np.linalg.eigh(matrix)
        matrix = vectors @ np.diag(np.clip(values, 1e-8, None)) @ vectors.T
        scale = np.sqrt(np.diag(matrix))
        matrix = matrix / np.outer(scale, scale)
    return Copula(margins, np.linalg.cholesky(matrix).tolist() if d else [], rows)


def _rounded(value: Column, digits: int) -> Column:
    """The nearest double of so many decimal places. F.round() goes through decimal numbers, which took most of the time of a made row."""
    scaled = value * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < F.lit(2.0**52), F.rint(scaled) / F.lit(10.0**digits)).otherwise(value)


def _drawn(margin: Margin, u: Column, row: Column, seed: int) -> Column:
    if margin.knots:
        grid, last = literal_array(margin.knots), len(margin.knots) - 1
        place = u * last
        at = F.least(F.floor(place).cast("int"), F.lit(last - 1)) if last else F.lit(0)
        low, high = F.get(grid, at), F.get(grid, F.least(at + 1, F.lit(last)))
        value = low + (high - low) * (place - at)
        if isinstance(margin.data_type, TEMPORAL):
            return F.timestamp_micros(value.cast("long")).cast(margin.data_type)
        if isinstance(margin.data_type, INTEGRAL):
            return F.round(value).cast(margin.data_type)
        return (_rounded(value, margin.digits) if margin.digits is not None else value).cast(margin.data_type)
    # no text comes twice: identifiers or free text, replaced by a surrogate
    mark = F.lower(F.hex(F.xxhash64(row, F.lit(margin.name), F.lit(seed))))
    return F.concat(F.lit(f"{margin.name}-"), mark).try_cast(margin.data_type)


def sample_copula(model: Copula, ids: DataFrame, row_id: str, seed: int = 42) -> DataFrame:
    """Draw the model's columns for every row of ``ids``, from hashes of ``row_id``; other columns stay."""
    row = F.col(row_id)
    linked = [m for m in model.margins if m.linked]
    made = ids.withColumns({f"_u{i}": hashed_uniform(row, F.lit(f"normal {i}"), F.lit(seed)) for i in range(len(linked))})
    width, factor = len(ids.columns), np.array(model.factor)

    def mixed(batches):
        """Correlated uniforms in the place of independent ones, the last columns; as column expressions, too long to be compiled."""
        for batch in batches:
            kept, drawn = batch.columns[:width], batch.columns[width:]
            z = factor @ normal_quantiles(np.vstack([c.to_numpy() for c in drawn]))
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(u) for u in normal_cdfs(z))], schema=batch.schema)

    if linked:
        made = made.mapInArrow(mixed, made.schema)
    ranks = {i: m.shares.rank(F.col(f"_u{i}")).alias(f"_r{i}") for i, m in enumerate(linked) if m.shares}
    if ranks:
        # a generator, through which no condition of the joins is copied into the expressions below it
        made = made.select("*", F.inline(F.array(F.struct(*ranks.values()))))
        for i in ranks:
            made = linked[i].shares.at(made, f"_r{i}", f"_v{i}")
    position = {m.name: i for i, m in enumerate(linked)}
    cells = []
    for m in model.margins:
        at = position.get(m.name)
        if m.shares:
            value = F.unhex(f"_v{at}") if isinstance(m.data_type, T.BinaryType) else F.col(f"_v{at}").cast(m.data_type)
        else:
            value = _drawn(m, F.col(f"_u{at}") if m.linked else F.lit(0.5), row, seed)
        gone = hashed_uniform(row, F.lit(f"missing {m.name}"), F.lit(seed)) < m.missing
        cells.append((F.when(~gone, value) if m.missing else value).alias(m.name))
    return made.select(*ids.columns, *cells)


def generate_copula(df: DataFrame, rows: int, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``rows`` new rows with the margins and correlations of ``df``."""
    if rows <= 0:
        raise ValueError("rows must be positive")
    model = fit_copula(df, columns)
    return sample_copula(model, df.sparkSession.range(rows), "id", seed).drop("id")


# ---- related tables ---------------------------------------------------------


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_key: str


BLOCK = 100_000


def _tasks(df: DataFrame) -> int:
    """Tasks for rows that are few but become many, which Spark, told no number, would put into one."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _children_wanted(fan: DataFrame, parents: int, seed: int) -> DataFrame:
    """(id, _wanted): numbers of children for parents 0 to ``parents`` - 1, in the shares that ``fan`` (_c) has.

    The histogram of children per parent is cut into as many equal parts as there are parents, so the largest families
    are there too, and with as many parents as before each number occurs as often as before. Which parent gets which
    number is a fixed shuffle of the ids.
    """
    histogram = fan.groupBy("_c").agg(F.count(F.lit(1)).alias("_parents"))
    upto = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)  # one row per number of children
    all_ = F.sum("_parents").over(Window.partitionBy())
    cuts = histogram.withColumn("_to", F.floor(F.sum("_parents").over(upto) * F.lit(parents) / all_ + F.lit(1e-9)).cast("long"))
    cuts = cuts.withColumn("_from", F.coalesce(F.lag("_to").over(Window.orderBy("_c")), F.lit(0))).filter("_to > _from")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_to") - F.col("_from") - 1) / BLOCK)))
    pieces = cuts.select("_c", "_from", "_to", piece.alias("_piece")).repartition(_tasks(fan), "_c", "_piece")
    begin = F.col("_from") + F.col("_piece") * BLOCK
    ranks = pieces.select("_c", F.explode(F.sequence(begin, F.least(begin + BLOCK, F.col("_to")) - 1)).alias("_rank"))
    step = next(k for k in range(int(parents * 0.618) + 1 + seed % 7, 2 * parents + 10) if math.gcd(k, parents) == 1)
    # a long has room for the product of most numbers of parents, and is quicker by far
    rank = F.col("_rank") if parents * step + abs(seed) < 2**63 else F.col("_rank").cast("decimal(38,0)")
    return ranks.select(F.pmod(rank * step + seed, F.lit(parents)).cast("long").alias("id"), F.col("_c").cast("long").alias("_wanted"))


def _numbered_children(parents: DataFrame, parent_id: str, children: str) -> tuple[DataFrame, int]:
    """One row per child: parent id and a dense number from 0; a parent of very many is split over tasks."""
    block = F.floor(F.col(parent_id) / BLOCK)
    tagged = parents.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(parent_id).rowsBetween(Window.unboundedPreceding, -1)
    started = tagged.withColumn("_before", F.coalesce(F.sum(children).over(inside), F.lit(0)))
    sums = tagged.groupBy("_block").agg(F.sum(children).alias("_n"))
    across = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_block", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    placed = started.join(F.broadcast(offsets), "_block").filter(F.col(children) > 0).select(
        parent_id, (F.col("_before") + F.col("_offset")).alias("_first"), F.col(children).alias("_n")
    )
    pieces = placed.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))))
    spread = pieces.repartition(_tasks(parents), parent_id, "_piece")
    within = F.sequence(F.col("_piece") * BLOCK, F.least((F.col("_piece") + 1) * BLOCK, F.col("_n")) - 1)
    return spread.select(F.col(parent_id).alias("_parent"), "_first", F.explode(within).alias("_i")).select(
        "_parent", (F.col("_first") + F.col("_i")).alias("_id")
    ), total


def generate_relational(tables: dict[str, DataFrame], keys: dict[str, str], foreign_keys: list[ForeignKey],
                        rows: int | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Synthetic versions of related tables.

    ``rows`` is wanted for the first table; the others scale along. Primary keys
    (``keys``) become dense numbers in the type of their column. A child table
    follows the observed numbers of children per parent of its first foreign
    key, the largest included; further foreign keys pick a parent each. Every
    foreign key therefore finds its parent, or is missing as often as it was.
    """
    spark = next(iter(tables.values())).sparkSession
    sizes = {name: df.count() for name, df in tables.items()}
    scale = rows / sizes[next(iter(tables))] if rows else 1.0
    owners = {name: [fk for fk in foreign_keys if fk.child == name] for name in tables}
    made: dict[str, DataFrame] = {}
    counts: dict[str, int] = {}
    waiting = list(tables)
    while waiting:
        ready = [name for name in waiting if all(fk.parent in made or fk.parent == name for fk in owners[name])]
        if not ready:
            raise ValueError(f"foreign keys form a cycle: {waiting}")
        for name in ready:
            waiting.remove(name)
            df, key = tables[name], keys[name]
            first = next((fk for fk in owners[name] if fk.parent != name), None)
            if first is None:
                counts[name] = max(1, round(sizes[name] * scale))
                base = spark.range(counts[name]).select(F.col("id").alias("_id"))
                linked: dict[str, Column] = {}
            else:
                parents = tables[first.parent].select(F.col(first.parent_key).alias("_k"))
                have = df.filter(F.col(first.column).isNotNull()).groupBy(F.col(first.column).alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
                fan = parents.join(have, "_k", "left").select(F.coalesce("_c", F.lit(0)).alias("_c"))
                base, total = _numbered_children(_children_wanted(fan, counts[first.parent], seed), "id", "_wanted")
                orphans = round(df.filter(F.col(first.column).isNull()).count() * counts[first.parent] / max(1, sizes[first.parent]))
                base = base.unionByName(spark.range(total, total + orphans).select(F.lit(None).cast("long").alias("_parent"), F.col("id").alias("_id")))
                counts[name] = total + orphans
                linked = {first.column: F.col("_parent")}
            others = [fk for fk in owners[name] if fk is not first]
            if others:
                missing = df.agg(*[F.avg(F.col(fk.column).isNull().cast("int")).alias(f"m{i}") for i, fk in enumerate(others)]).first()
            for i, fk in enumerate(others):
                size = counts.get(fk.parent, 1)
                there = hashed_uniform(F.col("_id"), F.lit(f"missing {fk.column}"), F.lit(seed)) >= (missing[f"m{i}"] or 0.0)
                linked[fk.column] = F.when(there, F.pmod(F.xxhash64(F.col("_id"), F.lit(fk.column), F.lit(seed)), F.lit(size)))
            plain = [c for c in df.columns if c != key and c not in linked]
            drawn = sample_copula(fit_copula(df, plain), base, "_id", seed) if plain else base
            cells = {key: F.col("_id"), **linked}
            made[name] = drawn.select(*[
                cells[c].cast("long").cast(df.schema[c].dataType).alias(c) if c in cells else quoted(c) for c in df.columns
            ])
    return made


def synthetic_report(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(column, measure, real, synthetic): the two profiles side by side."""
    def measures(df: DataFrame, side: str) -> DataFrame:
        shares = df.agg(*[(F.avg(present(df, c).isNull().cast("double")) * 100).alias(c) for c in df.columns])
        missing = shares.unpivot([], [quoted(c) for c in df.columns], "column", side).select(
            "column", F.lit("missing_pct").alias("measure"), side)
        parts = [missing]
        if any(kind(f.dataType) == "numeric" for f in df.schema.fields):
            stats = ["mean", "std", "min", "q25", "q50", "q75", "max"]
            numbers = describe_numeric(df).select("column", *stats)
            parts.append(numbers.unpivot(["column"], stats, "measure", side))
        if any(kind(f.dataType) == "text" for f in df.schema.fields):
            texts = describe_text(df).select("column", F.col("unique").cast("double").alias("unique"), "avg_len")
            parts.append(texts.unpivot(["column"], ["unique", "avg_len"], "measure", side))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    return measures(real, "real").join(measures(synthetic, "synthetic"), ["column", "measure"], "full")
