"""traceloom: analytics over AI-agent session data, written for Spark."""
