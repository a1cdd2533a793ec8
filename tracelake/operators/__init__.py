"""tracelake.operators"""
