"""Part of quizlake."""
