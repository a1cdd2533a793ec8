"""tracelake: Spark-native analytics over agent trajectories, chats and documents."""

__all__ = ["core", "functions", "operators", "plans", "sources", "streaming"]
