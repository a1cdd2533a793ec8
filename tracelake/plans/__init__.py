"""tracelake.plans"""
