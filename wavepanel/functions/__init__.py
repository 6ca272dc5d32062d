from .answers import (as_number, assertions, both_yes, collapse, is_answered, lookup,
                      percent, replace_values)

__all__ = ["as_number", "assertions", "both_yes", "collapse", "is_answered", "lookup",
           "percent", "replace_values"]
