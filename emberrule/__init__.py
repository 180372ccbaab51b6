"""emberrule: declarative production rules and data operators on Spark."""
