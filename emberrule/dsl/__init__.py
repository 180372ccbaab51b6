"""Part of emberrule."""
