"""List columns: arithmetic, summaries, strings and sets on arrays, as column expressions.

A null element is a missing value: it makes a summary null unless ``na_rm`` is given.  Empty lists give the neutral value
where there is one and null where there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _with(value: Column, body: Fn) -> Column:
    """``body`` of a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- elementwise -----------------------------------------------------------------------------------------------------


def recycled(a: Column | str, n: Column) -> Column:
    """A list repeated to ``n`` elements; an empty list stays empty."""
    a = _c(a)
    return _with(a, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(x, (i % F.size(x)).cast("int")))).otherwise(F.slice(x, 1, 0)))


def zipped(a: Column | str, b: Column | str, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` on two lists element by element; the shorter is repeated; if either is empty so is the result."""
    a, b = _c(a), _c(b)
    n = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.greatest(F.size(a), F.size(b)))
    long_a, long_b = F.when(F.size(a) == n, a).otherwise(recycled(a, n)), F.when(F.size(b) == n, b).otherwise(recycled(b, n))
    return F.zip_with(F.slice(long_a, F.lit(1), n), F.slice(long_b, F.lit(1), n), op)


def each(a: Column | str, op: Fn) -> Column:
    return F.transform(_c(a), op)


def with_scalar(a: Column | str, x: Column | str, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` on each element and one value of the row."""
    return F.transform(_c(a), lambda e: op(e, _c(x)))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(a / b)


def signif(x: Column, digits: int = 6) -> Column:
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x).otherwise(F.round(x * scale) / scale)


def complex_parts(re: Column, im: Column) -> dict[str, Column]:
    """Modulus, argument and conjugate of a complex number kept as two columns."""
    return {"mod": F.hypot(re, im), "arg": F.atan2(im, re), "conj_re": re, "conj_im": -im}


def if_else(test: Column | str, yes: Column | str, no: Column | str) -> Column:
    """Per element of ``test``: yes, no, or null where the test is null."""
    test, yes, no = _c(test), _c(yes), _c(no)
    n = F.size(test)
    both = F.struct(recycled(yes, n).alias("y"), recycled(no, n).alias("n"))
    return _with(both, lambda p: F.transform(test, lambda t, i: F.when(t, F.get(p["y"], i)).when(~t, F.get(p["n"], i))))


def pairwise(a: Column | str, b: Column | str, largest: bool = False) -> Column:
    """Element-wise least (largest) of two lists; null if either is."""
    pick = F.greatest if largest else F.least
    return zipped(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), pick(x, y)))


# ---- summaries -------------------------------------------------------------------------------------------------------


def present(a: Column | str) -> Column:
    return F.filter(_c(a), lambda e: e.isNotNull())


def _guard(a: Column | str, na_rm: bool, value: Fn) -> Column:
    a = _c(a)
    return value(present(a)) if na_rm else F.when(~F.exists(a, lambda e: e.isNull()), value(a))


def list_sum(a, *, na_rm: bool = False, kind: str = "long") -> Column:
    return _guard(a, na_rm, lambda x: F.aggregate(x, F.lit(0).cast(kind), lambda s, e: s + e.cast(kind)))


def list_prod(a, *, na_rm: bool = False) -> Column:
    return _guard(a, na_rm, lambda x: F.aggregate(x, F.lit(1.0), lambda s, e: s * e.cast("double")))


def list_min(a, *, na_rm: bool = False, empty=None) -> Column:
    return _guard(a, na_rm, lambda x: F.when(F.size(x) > 0, F.array_min(x)).otherwise(F.lit(empty)))


def list_max(a, *, na_rm: bool = False, empty=None) -> Column:
    return _guard(a, na_rm, lambda x: F.when(F.size(x) > 0, F.array_max(x)).otherwise(F.lit(empty)))


def list_range(a, *, na_rm: bool = False) -> Column:
    return F.struct(list_min(a, na_rm=na_rm).alias("low"), list_max(a, na_rm=na_rm).alias("high"))


def any_true(a, *, na_rm: bool = False) -> Column:
    """Three-valued: true if any is, else null if any is null."""
    return F.exists(present(a) if na_rm else _c(a), lambda e: e)


def all_true(a, *, na_rm: bool = False) -> Column:
    return F.forall(present(a) if na_rm else _c(a), lambda e: e)


def any_null(a) -> Column:
    return F.exists(_c(a), lambda e: e.isNull())


def which_min(a, *, before: Column | str | None = None) -> Column:
    """First place of the least element, nulls left out; null if there is none.  With ``before``, the number of elements
    in the lists before this one, the place counts through all of them."""
    a = _c(a)
    place = F.when(F.size(present(a)) > 0, F.array_position(a, F.array_min(a)))
    return place if before is None else place + _c(before)


def which_max(a, *, before: Column | str | None = None) -> Column:
    a = _c(a)
    place = F.when(F.size(present(a)) > 0, F.array_position(a, F.array_max(a)))
    return place if before is None else place + _c(before)


def trimmed(a, trim: float) -> Column:
    """A sorted list without the share ``trim`` (at most a half) of its elements at each end; from a half on the median
    is left, once or as the two in the middle."""
    a = F.array_sort(_c(a))
    n = F.size(a)
    cut = F.floor(n * F.lit(float(trim))).cast("int") if trim < 0.5 else F.floor((n - 1) / 2).cast("int")
    return F.slice(a, cut + 1, F.greatest(n - 2 * cut, F.lit(0)))


def list_mean(a, *, na_rm: bool = False, trim: float = 0.0) -> Column:
    """The mean, of the middle elements alone if ``trim`` cuts a share off both ends."""

    def mean(x: Column) -> Column:
        x = trimmed(x, trim) if trim > 0 else x
        return F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double")) / F.size(x))

    return _guard(a, na_rm, mean)


def list_var(a, *, na_rm: bool = False) -> Column:
    def var(x: Column) -> Column:
        n = F.size(x)
        mean = F.aggregate(x, F.lit(0.0), lambda s, e: s + e.cast("double")) / n
        return F.when(n > 1, _with(mean, lambda m: F.aggregate(x, F.lit(0.0), lambda s, e: s + (e - m) * (e - m))) / (n - 1))

    return _guard(a, na_rm, var)


def list_sd(a, *, na_rm: bool = False) -> Column:
    return F.sqrt(list_var(a, na_rm=na_rm))


def list_quantile(a, p: float, *, na_rm: bool = False) -> Column:
    """Linear interpolation between order statistics (position 1 + (n - 1) p)."""

    def at(x: Column) -> Column:
        s, n = F.array_sort(x), F.size(x)
        h = (n - 1) * F.lit(p)
        k = F.floor(h).cast("int")
        low, high = F.get(s, k).cast("double"), F.get(s, F.least(k + 1, n - 1)).cast("double")
        return F.when(n > 0, low + (h - k) * (high - low))

    return _guard(a, na_rm, at)


def list_median(a, *, na_rm: bool = False) -> Column:
    return list_quantile(a, 0.5, na_rm=na_rm)


def list_iqr(a, *, na_rm: bool = False) -> Column:
    return list_quantile(a, 0.75, na_rm=na_rm) - list_quantile(a, 0.25, na_rm=na_rm)


def list_mad(a, *, constant: float = 1.4826, na_rm: bool = False) -> Column:
    """Median distance from the median, scaled."""
    return constant * _with(list_median(a, na_rm=na_rm), lambda m: list_median(F.transform(_c(a), lambda e: F.abs(e - m)), na_rm=na_rm))


#: What cov and cor do about nulls: an error, a null result, or only the pairs without any (none left: null or an error).
USES = ("all.obs", "everything", "complete.obs", "na.or.complete", "pairwise.complete.obs")


def _complete(a, b, use: str) -> tuple[Column, Column]:
    if use not in USES:
        raise ValueError(f"use must be one of {USES}")
    a, b = _c(a), _c(b)
    if use == "everything":
        return a, b
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    whole = F.filter(both, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    wrong = F.size(whole) < F.size(both) if use == "all.obs" else F.size(whole) == 0 if use == "complete.obs" else F.lit(False)
    checked = F.when(wrong, F.raise_error(F.lit("missing values in cov or cor" if use == "all.obs" else "no complete pairs")).cast("array<double>"))
    return checked.otherwise(F.transform(whole, lambda p: p["x"].cast("double"))), F.transform(whole, lambda p: p["y"].cast("double"))


def list_cov(a, b, *, use: str = "everything") -> Column:
    """Sample covariance of two lists of one length; ``use`` says what becomes of nulls."""
    return _with(F.struct(*[x.alias(k) for k, x in zip("ab", _complete(a, b, use), strict=True)]), lambda p: _cov(p["a"], p["b"]))


def _cov(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + e)
    means = F.struct(list_mean(a).alias("a"), list_mean(b).alias("b"))
    products = _with(means, lambda m: total(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))))
    return F.try_divide(products, (F.size(a) - 1).cast("double"))


def list_cor(a, b, *, use: str = "everything") -> Column:
    pair = F.struct(*[x.alias(k) for k, x in zip("ab", _complete(a, b, use), strict=True)])
    return _with(pair, lambda p: F.try_divide(_cov(p["a"], p["b"]), list_sd(p["a"]) * list_sd(p["b"])))


def _tagged(a: Column) -> Column:
    """The elements with their places, sorted (nulls first)."""
    return F.array_sort(F.transform(a, lambda e, i: F.struct(e.isNotNull().alias("n"), e.alias("v"), i.alias("i"))))


def _below(ordered: Column, x: Column) -> Column:
    """How many elements of a sorted list are less than x, by halving: the steps grow with the logarithm of the list."""
    n = F.size(ordered)
    steps = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    start = F.struct(F.lit(0).alias("a"), n.alias("b"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        low = (s["a"] < s["b"]) & (F.get(ordered, mid) < x)
        return F.struct(F.when(low, mid + 1).otherwise(s["a"]).alias("a"), F.when(low | (s["a"] >= s["b"]), s["b"]).otherwise(mid).alias("b"))

    return F.aggregate(steps, start, halve, lambda s: s["a"])


def _key(e: Column, i: Column | int) -> Column:
    return F.struct(e.isNotNull().alias("n"), e.alias("v"), (F.lit(i) if isinstance(i, int) else i).alias("i"))


def average_ranks(a) -> Column:
    """Each element's rank, ties averaged."""
    return rank(a, "average")


def list_spearman(a, b) -> Column:
    return list_cor(average_ranks(a), average_ranks(b))


def list_kendall(a, b) -> Column:
    """Kendall's coefficient with ties (tau-b): the work grows with the square of the number of different pairs."""
    pairs = F.array_sort(F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))

    def tau(ordered: Column) -> Column:
        first = F.filter(F.transform(ordered, lambda p, i: F.when((i == 0) | (F.get(ordered, i - 1) != p), i)), lambda i: i.isNotNull())

        def counted(starts: Column) -> Column:
            times = F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(ordered))), lambda s, e: (e - s).cast("double"))
            return F.zip_with(starts, times, lambda s, n: F.struct(F.get(ordered, s)["x"].alias("x"), F.get(ordered, s)["y"].alias("y"), n.alias("n")))

        def over(kinds: Column) -> Column:
            total = lambda f: F.aggregate(kinds, F.lit(0.0), lambda s, p: s + F.aggregate(kinds, F.lit(0.0), lambda t, q: t + p["n"] * q["n"] * f(p, q)))
            same = total(lambda p, q: F.signum(p["x"] - q["x"]) * F.signum(p["y"] - q["y"]))
            nx, ny = total(lambda p, q: F.abs(F.signum(p["x"] - q["x"]))), total(lambda p, q: F.abs(F.signum(p["y"] - q["y"])))
            return F.try_divide(same, F.sqrt(nx * ny))

        return _with(_with(first, counted), over)

    return _with(pairs, tau)


# ---- order, sets, places ---------------------------------------------------------------------------------------------


def which(a) -> Column:
    """Places of the true elements."""
    return F.filter(F.transform(_c(a), lambda e, i: F.when(e, i + 1)), lambda i: i.isNotNull())


def is_null(a) -> Column:
    return F.transform(_c(a), lambda e: e.isNull())


def unique(a) -> Column:
    return F.array_distinct(_c(a))


def duplicated(a, *, from_last: bool = False) -> Column:
    """Whether each element stands earlier (later) in the list too."""
    a = _c(a)
    beside = 1 if from_last else -1
    return _with(_beside(a), lambda p: F.transform(p["a"], lambda e, i: F.coalesce(_same(F.get(p["t"], _below(p["t"], _key(e, i)) + beside), e), F.lit(False))))


def _beside(a: Column) -> Column:
    """A list (a), its elements sorted (t) and how many are null (n): columns of the row are not named inside lambdas, where
    an output column of the same name would take their place."""
    return F.struct(a.alias("a"), _tagged(a).alias("t"), F.size(F.filter(a, lambda e: e.isNull())).alias("n"))


def _same(tag: Column, e: Column) -> Column:
    return tag.isNotNull() & tag["v"].eqNullSafe(e)


def self_match(a) -> Column:
    """The first place of each element's value; null elements match none."""
    a = _c(a)
    return _with(_beside(a), lambda p: F.transform(p["a"], lambda e: F.when(e.isNotNull(), (F.get(p["t"], _below(p["t"], _key(e, -1)))["i"] + 1).cast("long"))))


def match_table(a, table: Column) -> Column:
    """The place of each element in a table, null if it isn't there."""
    return F.transform(_c(a), lambda e: F.nullif(F.array_position(table, e), F.lit(0)))


def set_intersect(a, b) -> Column:
    return F.array_intersect(_c(a), _c(b))


def order(a, *, decreasing: bool = False, na_last: bool | None = True) -> Column:
    """Places of the elements in sorted order, ties in place order; nulls last, first (``na_last`` False) or left out (None)."""
    last = na_last is not False
    tagged = F.transform(_c(a), lambda e, i: F.struct((e.isNull() if last else e.isNotNull()).alias("n"), (-e if decreasing else e).alias("v"), (i + 1).alias("i")))
    if na_last is None:
        tagged = F.filter(tagged, lambda s: s["v"].isNotNull())
    return F.transform(F.array_sort(tagged), lambda s: s["i"])


def rank(a, ties: str = "average") -> Column:
    """Each element's rank among those that aren't null; ties get the average, "min", "max" or the order of places ("first")."""
    if ties not in ("average", "min", "max", "first"):
        raise ValueError(f"ties can't be {ties}")
    a = _c(a)

    def ranks(all: Column) -> Column:
        t, nulls = all["t"], all["n"]
        low = lambda e: _below(t, _key(e, -1)) - nulls
        high = lambda e: _below(t, _key(e, F.size(t))) - nulls
        one = {"average": lambda e, i: (low(e) + high(e) + 1) / 2, "min": lambda e, i: low(e) + 1, "max": lambda e, i: high(e), "first": lambda e, i: _below(t, _key(e, i)) - nulls + 1}[ties]
        return F.transform(all["a"], lambda e, i: F.when(e.isNotNull(), one(e, i).cast("double")))

    return _with(_beside(a), ranks)


def is_unsorted(a, *, strictly: bool = False) -> Column:
    a = _c(a)
    after = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    worse = F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), after, (lambda x, y: x >= y) if strictly else (lambda x, y: x > y))
    return F.exists(worse, lambda w: w)


def heads(a, n: int) -> Column:
    """The first n elements; of a negative n all but the last -n."""
    a = _c(a)
    k = F.least(F.lit(n), F.size(a)) if n >= 0 else F.greatest(F.size(a) + n, F.lit(0))
    return F.slice(a, F.lit(1), k)


def tails(a, n: int) -> Column:
    a = _c(a)
    k = F.least(F.lit(n), F.size(a)) if n >= 0 else F.greatest(F.size(a) + n, F.lit(0))
    return F.when(k > 0, F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)).otherwise(F.slice(a, 1, 0))


def windows(a, start=None, end=None, width=None) -> Column:
    """A window of each list, as for ranges."""
    from ..model import solve_window

    a = _c(a)
    s, e = solve_window(F.size(a).cast("long"), start, end, width)
    return F.slice(a, s.cast("int"), (e - s + 1).cast("int"))


def reverse_if(a, chosen: Column) -> Column:
    return F.when(chosen, F.reverse(_c(a))).otherwise(_c(a))


def gather(a, at: Column | str) -> Column:
    """Elements by place (a list of places)."""
    a = _c(a)
    return F.transform(_c(at), lambda i: F.get(a, (i - 1).cast("int")))


# ---- running values --------------------------------------------------------------------------------------------------


def cumulate(a, how: str) -> Column:
    """cumsum, cumprod, cummin or cummax of a list, as doubles; a null makes all that follows null."""
    a = _c(a)
    step = {"sum": lambda s, e: s + e, "prod": lambda s, e: s * e, "min": lambda s, e: F.when(s.isNotNull() & e.isNotNull(), F.least(s, e)), "max": lambda s, e: F.when(s.isNotNull() & e.isNotNull(), F.greatest(s, e))}[how]
    empty = F.expr("cast(array() as array<double>)")
    return F.aggregate(a, empty, lambda acc, e: F.concat(acc, F.array(F.when(F.size(acc) == 0, e.cast("double")).otherwise(step(F.element_at(acc, -1), e.cast("double"))))))


def diff(a, lag: int = 1, times: int = 1) -> Column:
    """Differences of elements ``lag`` apart, ``times`` over."""
    a = _c(a)
    for _ in range(times):
        n = F.greatest(F.size(a) - lag, F.lit(0))
        a = F.zip_with(F.slice(a, F.lit(lag + 1), n), F.slice(a, F.lit(1), n), lambda x, y: x - y)
    return a


def _frames(a: Column, k: int) -> Column:
    """All windows of k elements."""
    n = F.size(a) - k + 1
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.slice(a, i, F.lit(k)))


def _edges(a: Column, inner: Column, k: int, rule: str) -> Column:
    if rule == "drop":
        return inner
    side = (k - 1) // 2
    rest = k - 1 - side
    return F.when(F.size(inner) > 0, F.concat(F.array_repeat(F.get(inner, F.lit(0)), side), inner, F.array_repeat(F.element_at(inner, -1), rest))).otherwise(inner)


def running(a, k: int, how: str, *, weights: list[float] | None = None, nth: int | None = None, rule: str = "drop", na_rm: bool = False) -> Column:
    """Moving sum, mean, weighted sum, n-th smallest or median over k elements.

    ``rule`` drop leaves out incomplete windows, constant repeats the first and last value to the list's length.  With
    ``na_rm`` nulls in a window are left out.
    """
    a = _c(a)
    clean = present if na_rm else (lambda w: w)
    total = lambda w: list_sum(w, na_rm=na_rm, kind="double")
    of = {
        "sum": total,
        "mean": lambda w: total(w) / F.size(clean(w)),
        "wtsum": lambda w: F.aggregate(F.zip_with(w, F.array(*[F.lit(float(x)) for x in weights or []]), lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e),
        "q": lambda w: F.get(F.array_sort(w), F.lit((nth or 1) - 1)).cast("double"),
        "median": lambda w: list_median(w, na_rm=na_rm),
    }[how]
    return _edges(a, F.transform(_frames(a, k), of), k, rule)


def running_median(a, k: int, *, rule: str = "median") -> Column:
    """Running median of odd k.

    At the ends: "keep" the values themselves, "constant" the nearest median, "median" medians of ever shorter odd
    windows with Tukey's rule for the first and last element.
    """
    a = _c(a)
    inner = F.transform(_frames(a, k), lambda w: list_median(w))
    if rule == "constant":
        return _edges(a, inner, k, "constant")
    side = k // 2
    plain = lambda part: F.transform(part, lambda e: e.cast("double"))
    kept = F.concat(plain(F.slice(a, 1, side)), inner, plain(tails(a, side)))
    kept = F.when(F.size(a) >= k, kept).otherwise(plain(a))
    return kept if rule == "keep" else smooth_ends(kept, k, original=a)


def _replaced(a: Column, from_start: dict[int, Column], from_end: dict[int, Column], n: Column) -> Column:
    """The list with new elements at places counted from its start (0 first) and its end (1 last)."""

    def pick(e: Column, j: Column) -> Column:
        out = F.when(F.lit(False), e)
        for i, value in from_start.items():
            out = out.when(j == i, value)
        for i, value in from_end.items():
            out = out.when(j == n - i, value)
        return out.otherwise(e)

    return F.transform(a, pick)


def smooth_ends(y, k: int = 3, original=None) -> Column:
    """End-point smoothing of a running median: shorter medians toward the ends, then Tukey's rule at the very end."""
    y = _c(y)
    x = F.transform(y if original is None else _c(original), lambda e: e.cast("double"))
    return _with(F.struct(y.alias("y"), x.alias("x")), lambda p: _smoothed(p["y"], p["x"], k))


def _smoothed(y: Column, x: Column, k: int) -> Column:
    side = k // 2
    n = F.size(y)
    out = y
    for i in range(2, side + 1):
        odd = 2 * i - 1
        left = list_median(F.slice(x, 1, odd))
        right = list_median(F.slice(x, F.greatest(n - odd + 1, F.lit(1)), F.lit(odd)))
        out = _replaced(out, {i - 1: left}, {i: right}, n)
    return _with(out, lambda done: _tukey(y, x, done, n))


def _tukey(y: Column, x: Column, done: Column, n: Column) -> Column:
    med3 = lambda a, b, c: a + b + c - F.least(a, b, c) - F.greatest(a, b, c)
    g = lambda i: F.get(done, F.lit(i))
    h = lambda i: F.get(done, n - 1 - i)
    xf, xl = F.get(x, F.lit(0)).cast("double"), F.get(x, n - 1).cast("double")
    first, last = med3(xf, g(1), 3 * g(1) - 2 * g(2)), med3(xl, h(1), 3 * h(1) - 2 * h(2))
    return F.when(n > 2, _replaced(done, {0: first}, {1: last}, n)).otherwise(y)


# ---- strings ---------------------------------------------------------------------------------------------------------


def sub(a, pattern: str, to: str, *, fixed: bool = False, ignore_case: bool = False) -> Column:
    """Replace the first match in each element."""
    import re

    body = re.escape(pattern) if fixed else pattern
    whole = f"(?s{'i' if ignore_case else ''})^(.*?)(?:{body})"
    return F.transform(_c(a), lambda e: F.regexp_replace(e, whole, "$1" + to.replace("\\", "\\\\").replace("$", "\\$")))


def gsub(a, pattern: str, to: str, *, fixed: bool = False, ignore_case: bool = False) -> Column:
    import re

    body = ("(?i)" if ignore_case else "") + (re.escape(pattern) if fixed else pattern)
    return F.transform(_c(a), lambda e: F.regexp_replace(e, body, to))


def grepl(a, pattern: str, *, ignore_case: bool = False) -> Column:
    return F.transform(_c(a), lambda e: e.rlike(("(?i)" if ignore_case else "") + pattern))


def grep(a, pattern: str, *, value: bool = False, invert: bool = False) -> Column:
    """Places (or values) of the elements that match."""
    hit = (lambda e: ~e.rlike(pattern)) if invert else (lambda e: e.rlike(pattern))
    if value:
        return F.filter(_c(a), hit)
    return which(F.transform(_c(a), hit))


def paste(a, b, sep: str = " ", collapse: str | None = None) -> Column:
    out = zipped(a, b, lambda x, y: F.concat(x.cast("string"), F.lit(sep), y.cast("string")))
    return F.array_join(out, collapse) if collapse is not None else out
