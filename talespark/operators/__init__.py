"""DataFrame -> DataFrame operators on stories, scripts, casts, logs and projects."""
