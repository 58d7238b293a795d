"""Boundary codes and node types: what a node may do with flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundary codes.
NO_FLOW, FLOW, FLOW_BUT, CAN_OUT, OUT, FORCE_OUT, CANNOT_OUT, IN, FORCE_IN, PERIODIC_BORDER = range(10)
CODE_NAMES = ("NO_FLOW", "FLOW", "FLOW_BUT", "CAN_OUT", "OUT", "FORCE_OUT", "CANNOT_OUT", "IN", "FORCE_IN", "PERIODIC_BORDER")
# Node types of the second numbering; never mix it with the codes.
NO_DATA, NORMAL, HAS_TO_OUT, T_CAN_OUT, T_IN, PERIODIC, REFLECT = range(7)
TYPE_NAMES = ("NO_DATA", "NORMAL", "HAS_TO_OUT", "CAN_OUT", "IN", "PERIODIC", "REFLECT")


def _in(code: Column, *codes: int) -> Column:
    return code.isin(*codes)


def is_no_data(code: Column) -> Column:
    return code == NO_FLOW


def is_normal(code: Column) -> Column:
    return _in(code, FLOW, FLOW_BUT)


def can_receive(code: Column) -> Column:
    return ~_in(code, NO_FLOW, IN, FORCE_IN)


def can_give(code: Column) -> Column:
    return ~_in(code, NO_FLOW, OUT, FORCE_OUT)


def can_out(code: Column) -> Column:
    return _in(code, CAN_OUT, OUT, FORCE_OUT)


def has_to_out(code: Column) -> Column:
    return _in(code, OUT, FORCE_OUT)


def forces_giving(code: Column) -> Column:
    return code == FORCE_IN


def forces_receiving(code: Column) -> Column:
    return code == FORCE_OUT


def is_inlet(code: Column) -> Column:
    return _in(code, IN, FORCE_IN)


def is_periodic(code: Column) -> Column:
    return code == PERIODIC_BORDER


def is_closed(code: Column) -> Column:
    return code == CANNOT_OUT


def is_active(code: Column) -> Column:
    return code != NO_FLOW


def is_border(code: Column) -> Column:
    return ~_in(code, NO_FLOW, FLOW, FLOW_BUT)


def can_create_link(code: Column) -> Column:
    return code != NO_FLOW


def needs_care(code: Column) -> Column:
    """Whether a neighbour lookup has to treat the node on its own: everything but plain flow."""
    return code != FLOW


PREDICATES = {
    f.__name__: f
    for f in (is_no_data, is_normal, can_receive, can_give, can_out, has_to_out, forces_giving, forces_receiving, is_inlet, is_periodic, is_closed, is_active, is_border, can_create_link, needs_care)
}


def code_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in CODE_NAMES]), code.cast("int"))


def type_name(kind: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in TYPE_NAMES]), kind.cast("int"))


def type_from_name(name: Column) -> Column:
    """The number of a type's name; null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(n) for n in TYPE_NAMES]), name)
    return F.when(at > 0, at - 1).cast("byte")


def allows_outflow(kind: Column) -> Column:
    return _in(kind, HAS_TO_OUT, T_CAN_OUT)


def allows_inflow(kind: Column) -> Column:
    return _in(kind, NORMAL, T_CAN_OUT, T_IN, PERIODIC)


def type_is_active(kind: Column) -> Column:
    return kind != NO_DATA


def type_is_boundary(kind: Column) -> Column:
    return ~_in(kind, NO_DATA, NORMAL)


def at_boundaries(code: Column, value: Column, at: Column | float) -> Column:
    """``at`` where flow may leave, else the value."""
    return F.when(can_out(code), at).otherwise(value)


def valid(code: Column) -> Column:
    """Whether a node has data."""
    return code != NO_FLOW
