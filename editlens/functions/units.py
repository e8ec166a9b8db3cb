"""Units of one recording: times, neighbours, masks and pairs as array expressions.

A recording's units arrive nested in its row, so none of these shuffles. Inputs
are SQL expression strings; ``timed`` is the array built by ``timed_units``.
"""

from __future__ import annotations

TEXT_KINDS = "('ins', 'del', 'sub')"


def let(name: str, value: str, body: str) -> str:
    """Bind a value once inside one expression.

    The optimizer may merge projections and copy a shared column into every
    lambda that reads it; a bound variable is computed once per row.
    """
    return f"transform(array({value}), {name} -> {body})[0]"


def timed_units(spans: str, units: str) -> str:
    """Character bounds and times of the units in one array."""
    return (
        f"zip_with({spans}, {units}, (s, u) -> named_struct('a', s.start, 'b', s.end, 'pre', s.pre,"
        " 'post', s.post, 'word', u.word, 't0', u.start, 't1', u.end))"
    )


def span_start(timed: str, a: str, b: str) -> str:
    """Start time of the first unit inside the character span."""
    return f"get(filter({timed}, u -> u.a >= {a} and u.b <= {b}), 0).t0"


def span_end(timed: str, a: str, b: str) -> str:
    inside = f"filter({timed}, u -> u.a >= {a} and u.b <= {b})"
    return f"try_element_at({inside}, -1).t1"


def left_of(timed: str, point: str) -> str:
    """The last unit that ends at or before a point of the text (as-of lookup)."""
    return f"try_element_at(filter({timed}, u -> u.b <= {point}), -1)"


def right_of(timed: str, point: str) -> str:
    return f"get(filter({timed}, u -> u.a >= {point}), 0)"


def cuts_unit(timed: str, point: str) -> str:
    return f"exists({timed}, u -> u.a < {point} and {point} < u.b)"


def interval(timed: str, a: str, b: str, duration: str) -> str:
    """Times of a span; a zero-width span gives the gap between its neighbours."""
    return f"""if({a} < {b},
      named_struct('start', {span_start(timed, a, b)}, 'end', {span_end(timed, a, b)}),
      named_struct('start', coalesce({left_of(timed, a)}.t1, 0D), 'end', coalesce({right_of(timed, a)}.t0, {duration})))"""


def anchors_valid(timed: str, point: str) -> str:
    """Both neighbours that exist have a positive length, and at least one exists."""
    left, right = left_of(timed, point), right_of(timed, point)
    return (
        f"(({left} is not null or {right} is not null)"
        f" and coalesce({left}.t1 > {left}.t0, true) and coalesce({right}.t1 > {right}.t0, true))"
    )


def marked(timed: str, a: str, b: str) -> str:
    """Ordinals of the units an edit of [a, b) touches; an edited connector marks both sides."""
    return f"""filter(transform({timed}, (u, i) -> if({a} < {b} and (
        (u.a < {b} and u.b > {a})
        or (u.post and u.b >= {a} and u.b < {b})
        or (u.pre and u.a > {a} and u.a <= {b})), i, -1)), i -> i >= 0)"""


def masked_by_others(timed: str, ops: str, side: str, scope: str) -> str:
    """Units touched by any operation but those of the scope kind."""
    return (
        f"flatten(transform(filter({ops}, o -> o.kind <> '{scope}'),"
        f" o -> {marked(timed, f'o.{side}_start', f'o.{side}_end')}))"
    )


def preserved_pairs(regions: str, ops: str, source: str, target: str, scope: str) -> str:
    """(source ordinal, target ordinal) of kept units, plus those of the orthogonal kind.

    A region whose two sides disagree in number yields a null partner, which the
    alignment check reports.
    """

    def side(timed: str, name: str) -> str:
        mine = marked(timed, f"r.{name}_start", f"r.{name}_end")
        return f"array_except({mine}, {masked_by_others(timed, ops, name, scope)})"

    # array_except also drops repeats; a region has none.
    return f"""array_distinct(flatten(transform(
        filter({regions}, r -> r.kind in ('equal', '{scope}')),
        r -> zip_with({side(source, 'src')}, {side(target, 'tgt')}, (i, j) -> named_struct('s', i, 't', j)))))"""


def operation_pairs(source: str, target: str, op: str) -> str:
    """Ordinal pairing of the units of an acoustic operation."""
    left = marked(source, f"{op}.src_start", f"{op}.src_end")
    right = marked(target, f"{op}.tgt_start", f"{op}.tgt_end")
    return f"zip_with({left}, {right}, (i, j) -> named_struct('s', i, 't', j))"


def resolve(pairs: str, source: str, target: str) -> str:
    """Replace ordinals by words and times."""
    return f"""transform({pairs}, p -> named_struct('i', p.s, 'j', p.t,
        'sw', get({source}, p.s).word, 's0', get({source}, p.s).t0, 's1', get({source}, p.s).t1,
        'tw', get({target}, p.t).word, 't0', get({target}, p.t).t0, 't1', get({target}, p.t).t1))"""


def bounded(units: str, duration: str) -> str:
    """Clamp units into the recording; a unit that ends before it starts is an error."""
    return f"""transform({units}, u -> named_struct('word', u.word,
        'start', if(u.end < u.start, double(raise_error('unit ends before it starts')), least({duration}, greatest(0D, u.start))),
        'end', least({duration}, greatest(0D, u.end))))"""
