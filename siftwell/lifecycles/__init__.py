"""Whole runs composed of the operators: diagnosis of a teacher, a training mixture, evaluation of a trained model, run logs.

Plans stay lazy and group by group; only aggregates of a bounded number of groups, top lists and reports reach the driver.
"""
