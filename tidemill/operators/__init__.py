"""The named clean-up operations and the table-level operators."""
