from cohortloom.functions import dates, numbers, text

__all__ = ["dates", "numbers", "text"]
