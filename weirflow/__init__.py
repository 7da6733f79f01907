"""PySpark-native analytics over keyed, event-time data."""
