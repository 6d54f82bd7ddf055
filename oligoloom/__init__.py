"""Design and analysis of pools of short DNA oligos on Spark."""
