"""tracelake.streaming"""
