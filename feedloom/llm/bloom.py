"""The filter of ``feedloom.functions.bloom`` under its former name."""

from feedloom.functions.bloom import MAX_BITS, maybe_in, might_be  # noqa: F401
