"""heddle: DataFrame building blocks for form-style validation data and compliance reporting on Spark."""
