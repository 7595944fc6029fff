"""webplan.plans"""
