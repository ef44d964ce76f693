"""Operators: functions from DataFrame to DataFrame over columns country, indicator, member, year and value.

None of them runs a job, and none pulls rows to the driver.
"""
