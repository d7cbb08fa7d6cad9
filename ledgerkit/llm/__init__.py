"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing outside this subpackage imports it (``__spark_entry__.py`` adds its queries
when it is present)."""

from ledgerkit import ship_by_value

ship_by_value(__name__)  # holds for all modules of the subpackage
