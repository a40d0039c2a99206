"""Calendar, SQL dialect and formatting functions."""
