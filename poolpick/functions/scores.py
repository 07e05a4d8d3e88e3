"""Column builders for log-softmax, margins and cross entropy on logit arrays.

All builders are JVM-side higher-order functions (``transform``,
``aggregate``, ``sort_array``), so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = -100  # label value meaning "ignore this position"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(z) -> Column:
    return F.aggregate(_col(z), F.lit(0.0), lambda acc, x: acc + x)


def _bind(value, use) -> Column:
    """``use(x)`` with ``value`` evaluated once: Spark re-evaluates an expression at each mention
    (inside a lambda: for each element), a lambda variable not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def logsumexp(z) -> Column:
    """log(sum(exp(z))), shifted by the maximum for stability; linear in the number of classes."""
    z = _col(z)
    return _bind(F.array_max(z), lambda m: m + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))


def log_softmax(z) -> Column:
    z = _col(z)
    return _bind(logsumexp(z), lambda lse: F.transform(z, lambda x: x - lse))


def top2_margin(z) -> Column:
    """Largest minus second-largest value (the softmax normaliser cancels)."""
    s = F.sort_array(_col(z), asc=False)
    return F.try_element_at(s, F.lit(1)) - F.try_element_at(s, F.lit(2))


def max_log_prob(z) -> Column:
    """Largest log-softmax value: max(z) - logsumexp(z)."""
    z = _col(z)
    return F.array_max(z) - logsumexp(z)


def cross_entropy(z, label) -> Column:
    """-log softmax(z)[label] for a 0-based label; 0 when the label is masked."""
    z, label = _col(z), _col(label)
    return F.when(label == MASK, F.lit(0.0)).otherwise(
        logsumexp(z) - F.try_element_at(z, (label + 1).cast("int")))


def argmax(z) -> Column:
    """0-based position of the first maximum."""
    z = _col(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def masked_margin(z, label) -> Column:
    """Per-position margin with masked positions set to 0 (their log-probs are zeroed)."""
    z, label = _col(z), _col(label)
    return F.when(label == MASK, F.lit(0.0)).otherwise(top2_margin(z))


def percent(v) -> Column:
    """Scale a fraction to percent, per value: v < 1 -> v*100 (exactly 1.0 stays)."""
    v = _col(v)
    return F.when(v < 1, v * 100).otherwise(v)
