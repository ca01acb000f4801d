"""findsieve: Spark jobs that decide which scanner findings are real."""
