"""Exact rational values as struct<num: string, den: string> columns, of any length.

Both sides are decimal integers in lowest terms, the denominator positive, without
leading zeros, so equal values are equal structs.  Sides that fit a bigint are
computed as such; longer ones as arrays of limbs of nine digits, the lowest first,
in ``_axpy`` steps.  Bodies are SQL text with lambda variables, because a tree of
this size takes seconds to build from single Column calls.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable
from itertools import count

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\s*/\s*\d+|\d+\.\d+|\d+)"
RATIO, POINT = re.compile(r"([-+]?[0-9]+)(?:/(-?[0-9]+))?"), re.compile(r"([-+]?[0-9]+)[.]([0-9]+)")
RATIONAL_TYPE = "struct<num:string,den:string>"
DIGITS = 9
LIMB = f"{10**DIGITS}L"
NO_LIMBS = "cast(array() as array<bigint>)"

_fresh = count()


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once, also inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _minus(text: str) -> str:
    return f"startswith({text}, '-')"


def _let(value: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_fresh)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _with(value: Column, body: Callable[[str], str]) -> Column:
    """The SQL text ``body`` of a lambda variable that stands for ``value``."""
    name = f"v{next(_fresh)}"
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body(name)}")), 1)


def _value(num: str, den: str) -> str:
    return f"named_struct('num', {num}, 'den', {den})"


# ---- limbs: arrays of bigint below LIMB, the lowest first, no zeros on top; zero is empty ------------------

def _limbs(text: str) -> str:
    """Limbs of a decimal integer, its sign dropped."""

    def cut(d: str) -> str:
        size = f"cast(ceil(length({d}) / {DIGITS}) as int)"
        pieces = _let(f"lpad({d}, {size} * {DIGITS}, '0')", lambda t: (
            f"transform(sequence(1, length({t}) div {DIGITS}), i -> cast(substring({t}, length({t}) - cast(i as int) * {DIGITS} + 1, {DIGITS}) as bigint))"))
        return f"if({d} = '', {NO_LIMBS}, {pieces})"

    return _let(f"regexp_replace({text}, '^[-+]?0*', '')", cut)


def _digits(limbs: str) -> str:
    """Decimal text of limbs."""
    joined = f"array_join(transform(reverse({limbs}), x -> lpad(cast(x as string), {DIGITS}, '0')), '')"
    return f"coalesce(nullif(regexp_replace({joined}, '^0+', ''), ''), '0')"


def _less(a: str, b: str) -> str:
    return f"(size({a}) < size({b}) or (size({a}) = size({b}) and reverse({a}) < reverse({b})))"


def _axpy(a: str, q: str, b: str, shift: str) -> str:
    """a + q * b * LIMB**shift, which must not be negative; the size of q is below LIMB."""
    # Zeros on top leave room for what is carried out of either.
    sums = (f"zip_with(concat({a}, array(0L)), concat(array_repeat(0L, {shift}), {b}, array(0L, 0L)), "
            f"(x, y) -> coalesce(x, 0L) + {q} * coalesce(y, 0L))")
    step = _let("x + s.carry", lambda v: f"named_struct('out', concat(s.out, array(pmod({v}, {LIMB}))), 'carry', ({v} - pmod({v}, {LIMB})) div {LIMB})")
    carried = f"aggregate({sums}, named_struct('out', {NO_LIMBS}, 'carry', 0L), (s, x) -> {step}, s -> s.out)"
    return _let(carried, lambda out: f"slice({out}, 1, coalesce(array_max(transform({out}, (x, i) -> if(x <> 0, i + 1, 0))), 0))")


def _product(a: str, b: str) -> str:
    places = f"transform({b}, (q, i) -> named_struct('q', q, 'i', i))"
    return f"aggregate({places}, {NO_LIMBS}, (t, p) -> {_axpy('t', 'p.q', a, 'p.i')})"


def _quotient(a: str, b: str) -> str:
    """struct(q, shift) with q * LIMB**shift at most a / b and close to it, for a >= b > 0."""
    # Three limbs hold 19 digits or more; the factor covers the rounding of doubles.
    lead = lambda x: f"aggregate(slice(concat(array(0L, 0L), {x}), -3, 3), 0D, (s, x) -> s / {LIMB} + x)"
    apart = f"(size({a}) - size({b}))"
    return _let(f"{lead(a)} / {lead(b)} * {1 - 1e-14!r}D", lambda r: (
        f"if({r} >= 1 or {apart} = 0, named_struct('q', greatest(cast(floor({r}) as bigint), 1L), 'shift', {apart}), "
        f"named_struct('q', least(cast(floor({r} * {LIMB}) as bigint), {LIMB} - 1L), 'shift', {apart} - 1))"))


def _lowest_limbs(num: str, den: str) -> str:
    """struct(num, den) of limbs in lowest terms.

    Euclid's steps keep (num, den) = [[p, r], [s, t]] (a, b) until b is zero; then
    num / den = p / s in lowest terms.  The state is x = [a, r, t] and y = [b, p, s]:
    a step takes q * y off a and adds q * y to r and t, and swaps x and y once a < b.
    """
    state = lambda x, y: f"named_struct('x', {x}, 'y', {y})"
    x, y = f"array({num}, {NO_LIMBS}, array(1L))", f"array({den}, array(1L), {NO_LIMBS})"
    start = f"if({_less(num, den)}, {state(y, x)}, {state(x, y)})"
    added = lambda q: f"transform(s.x, (l, k) -> {_axpy('l', f'if(k = 0, -{q}.q, {q}.q)', 's.y[k]', f'{q}.shift')})"
    turned = lambda n: f"if({_less(f'{n}[0]', 's.y[0]')}, {state('s.y', n)}, {state(n, 's.y')})"
    step = _let(_quotient("s.x[0]", "s.y[0]"), lambda q: _let(added(q), turned))
    # At most five steps a digit of the smaller side (twice that for low estimates), and some for each limb the larger is longer.
    size, other = f"size({num})", f"size({den})"
    steps = f"sequence(1, {10 * DIGITS} * least({size}, {other}) + 2 * greatest({size}, {other}) + 4)"
    return f"aggregate({steps}, {start}, (s, j) -> if(size(s.y[0]) = 0, s, {step}), s -> {_value('s.y[1]', 's.y[2]')})"


# ---- integers of any length as canonical decimal text ------------------------------------------------------

def _whole(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^[+]?(-?)0*(?=[0-9])', '$1'), '^-0$', '0')"


def whole(text: Column) -> Column:
    """Canonical text of a decimal integer: no plus sign, no leading zeros, no minus zero."""
    return _with(text, _whole)


def _signed(negative: str, digits: str) -> str:
    return _let(digits, lambda d: f"if({negative} and {d} <> '0', concat('-', {d}), {d})")


def _both(x: Column, y: Column, body: Callable[[str], str]) -> Column:
    return _with(F.struct(x.alias("x"), y.alias("y")), body)


def times(x: Column, y: Column) -> Column:
    """Product of two integers."""

    def product(s: str) -> str:
        long = _let(_limbs(f"{s}.x"), lambda a: _let(_limbs(f"{s}.y"), lambda b: _digits(_product(a, b))))
        short = f"cast(try_multiply(try_cast({s}.x as bigint), try_cast({s}.y as bigint)) as string)"
        return f"coalesce({short}, {_signed(f'{_minus(f"{s}.x")} <> {_minus(f"{s}.y")}', long)})"

    return _both(x, y, product)


def plus(x: Column, y: Column) -> Column:
    """Sum of two integers."""
    def total(s: str) -> str:
        side = lambda k: f"named_struct('minus', {_minus(f'{s}.{k}')}, 'limbs', {_limbs(f'{s}.{k}')})"

        def added(p: str) -> str:  # the larger first
            sign = f"if({p}.x.minus = {p}.y.minus, 1L, -1L)"
            return _signed(f"{p}.x.minus", _digits(_axpy(f"{p}.x.limbs", sign, f"{p}.y.limbs", "0")))

        ordered = _let(f"named_struct('x', {side('x')}, 'y', {side('y')})", lambda p: (
            f"if({_less(f'{p}.x.limbs', f'{p}.y.limbs')}, named_struct('x', {p}.y, 'y', {p}.x), {p})"))
        short = f"cast(try_add(try_cast({s}.x as bigint), try_cast({s}.y as bigint)) as string)"
        return f"coalesce({short}, {_let(ordered, added)})"

    return _both(x, y, total)


def _gcd(a: str, b: str) -> str:
    """Greatest common divisor of two bigints that are not negative; Euclid's steps over a bounded sequence."""
    # At most five steps per decimal digit of the second, and one to start.
    return (f"aggregate(sequence(1, length(cast({b} as string)) * 5 + 2), named_struct('a', {a}, 'b', {b}), "
            "(s, j) -> if(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)")


def _fraction(s: str) -> str:
    """Value of a struct(num, den) of canonical integers, the denominator not zero."""
    negative = f"({_minus(f'{s}.num')} <> {_minus(f'{s}.den')})"
    # 18 digits a side and the sign fit a bigint.
    fits = f"length({s}.num) <= 18 and length({s}.den) <= 18"
    sizes = _value(f"abs(cast({s}.num as bigint))", f"abs(cast({s}.den as bigint))")
    part = lambda n, g: f"cast({n} div {g} as string)"
    divided = lambda p: _let(_gcd(f"{p}.num", f"{p}.den"), lambda g: _value(_signed(negative, part(f"{p}.num", g)), part(f"{p}.den", g)))
    limbs = _value(_limbs(f"{s}.num"), _limbs(f"{s}.den"))
    lowest = _let(limbs, lambda p: _lowest_limbs(f"{p}.num", f"{p}.den"))
    long = _let(lowest, lambda v: _value(_signed(negative, _digits(f"{v}.num")), _digits(f"{v}.den")))
    zero = _value("'0'", "'1'")
    return f"if({s}.den = '1', {s}, if({s}.num = '0', {zero}, if({fits}, {_let(sizes, divided)}, {long})))"


def _reduced(num: str, den: str) -> str:
    return _let(_value(_whole(num), _whole(den)), lambda s: f"if({s}.den <> '0', {_fraction(s)}, null)")


def fraction(num: Column, den: Column) -> Column:
    """Value of num / den for integer texts of any length; a zero denominator gives null."""
    return _both(num, den, lambda s: _reduced(f"{s}.x", f"{s}.y"))


def parse(token: Column) -> Column:
    """Value of 'a/b', a decimal or an integer of any length; blanks are dropped, a zero denominator gives null."""

    def sides(t: str) -> str:
        scale = f"rpad('1', length({t}) - instr({t}, '.') + 1, '0')"
        plain, ratio, point = _value(t, "'1'"), _value(f"split_part({t}, '/', 1)", f"split_part({t}, '/', 2)"), _value(f"replace({t}, '.', '')", scale)
        return (f"case when {t} rlike '^[-+]?[0-9]+$' then {plain} when {t} rlike '^[-+]?[0-9]+/-?[0-9]+$' then {ratio} "
                f"when {t} rlike '^[-+]?[0-9]+[.][0-9]+$' then {point} end")

    return _with(F.replace(token, F.lit(" "), F.lit("")), lambda t: _let(sides(t), lambda s: f"if({s} is not null, {_reduced(f'{s}.num', f'{s}.den')}, null)"))


def parse_all(tokens: Column) -> Column:
    """``parse`` of every element of an array column, in Arrow batches, each distinct token once; not for use inside lambdas."""

    def values(tokens: pa.Array) -> pa.Array:
        sys.set_int_max_str_digits(0)
        flat = tokens.flatten().dictionary_encode()
        nums, dens, odd = [], [], []
        for token in flat.dictionary.to_pylist():
            t = token.replace(" ", "")
            ratio, point = RATIO.fullmatch(t), POINT.fullmatch(t)
            num, den = (int(ratio[1]), int(ratio[2] or 1)) if ratio else (int(point[1] + point[2]), 10 ** len(point[2])) if point else (0, 0)
            common = math.gcd(num, den) * (-1 if den < 0 else 1) or 1
            nums.append(str(num // common))
            dens.append(str(den // common))
            odd.append(den == 0)
        at = flat.indices.fill_null(len(odd))  # the last entry stands for a null token
        sides = [pa.array([*side, ""], pa.string()).take(at) for side in (nums, dens)]
        found = pa.StructArray.from_arrays(sides, ["num", "den"], mask=pa.array([*odd, True], pa.bool_()).take(at))
        starts = pc.subtract(tokens.offsets, tokens.offsets[0])
        return pa.ListArray.from_arrays(starts, found, mask=tokens.is_null() if tokens.null_count else None)

    return F.arrow_udf(values, f"array<{RATIONAL_TYPE}>")(tokens)


def as_double(value: Column) -> Column:
    return let(value, lambda v: v["num"].cast("double") / v["den"].cast("double"))


def equal(a: Column, b: Column) -> Column:
    return a == b  # lowest terms


def lists_equal(a: Column, b: Column) -> Column:
    """Same length and equal values in order; null lists are not equal."""
    same = (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(equal(x, y), F.lit(False))), lambda ok: ok)
    return F.coalesce(same, F.lit(False))


def contains(values: Column, wanted: Column) -> Column:
    return F.exists(values, lambda v: equal(v, wanted))


def contains_all(values: Column, wanted: Column) -> Column:
    return F.forall(wanted, lambda w: F.exists(values, lambda v: equal(v, w)))


def to_text(value: Column) -> Column:
    """'n' or 'n/d' in lowest terms."""
    return let(value, lambda v: F.when(v["den"] == "1", v["num"]).when(v.isNotNull(), F.concat_ws("/", v["num"], v["den"])))


def add_one(value: Column) -> Column:
    return let(value, lambda v: F.struct(plus(v["num"], v["den"]).alias("num"), v["den"].alias("den")))


def answer_parts(answer: Column) -> Column:
    """Parts of '(a, b, c)' without blanks and empties; any other answer is one part."""
    t = F.trim(answer)
    inner = F.substring(t, 2, 2147483647)
    inner = F.substring(inner, F.lit(1), F.length(inner) - 1)
    parts = F.filter(F.transform(F.split(inner, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(t.startswith("(") & t.endswith(")"), parts).otherwise(F.array(t))


def answer_values(answer: Column) -> Column:
    """Values of all parts of an answer; null as soon as one part does not parse."""
    values = F.transform(answer_parts(answer), parse)
    return let(values, lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), vs))


def tuple_text(values: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(values, to_text), ", "), F.lit(")"))


def perturbed_answer(answer: Column, answer_type: Column) -> Column:
    """Answer with 1 added to its value, or to the first element of a tuple."""
    values = answer_values(answer)
    bumped = F.transform(values, lambda v, i: F.when(i == 0, add_one(v)).otherwise(v))
    is_tuple = (answer_type == "tuple") | F.trim(answer).startswith("(")
    single = answer_type.isin("integer", "fraction", "decimal")
    return (
        F.when(is_tuple, tuple_text(bumped))
        .when(single, F.coalesce(to_text(F.try_element_at(bumped, F.lit(1))), F.concat(F.trim(answer), F.lit(" + 1"))))
        .otherwise(F.concat(F.lit("a plausible wrong answer different from "), F.trim(answer)))
    )


def complexity(answer: Column) -> Column:
    """Number count, non-integer count and largest denominator of an answer text (null where it exceeds a bigint)."""
    tokens = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(-?\d+\s*/\s*-?\d+|-?\d+(?:\.\d+)?)"), 1)
    dens = F.transform(F.filter(F.transform(tokens, parse), lambda v: v.isNotNull()), lambda v: v["den"])
    largest = F.array_max(F.transform(dens, lambda d: F.struct(F.length(d).alias("size"), d.alias("den"))))["den"]
    return F.struct(
        F.size(dens).alias("answer_num_count"), F.size(F.filter(dens, lambda d: d != "1")).alias("answer_nonint_count"),
        F.coalesce(largest, F.lit("1")).try_cast("bigint").alias("answer_max_den"),
    )
